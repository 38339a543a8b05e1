"""Planted structures for operators that SQL does not check, and edge cases."""

from attestor.operators import corroboration as C
from attestor.operators import intake as I
from attestor.operators import linking as L
from attestor.operators.graph import connected_components


def test_components_of_chain_star_and_islands(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (9, None), (5, 4), (4, 5)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[1000 + i] == 1000 for i in range(50))
    assert got[4] == got[5] == 4
    assert 7 not in got and 9 not in got


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_registry_sync(spark):
    a = spark.createDataFrame([("x",), ("y",)], "url string")
    b = spark.createDataFrame([("y",), ("z",)], "url string")
    assert {tuple(r) for r in I.sync_registry(a, b).collect()} == {("x", "disable"), ("y", "keep"), ("z", "insert")}


def test_chain_roots_follow_to_the_end(spark):
    p = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, 8), (8, None)], "n long, p long")
    assert {r.n: r.root for r in L.chain_roots(p, "n", "p").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 8, 8: 8}


def dated(spark, rows):
    """(id, text, hours after the first day)."""
    return spark.createDataFrame(rows, "article_id long, text string, h double").selectExpr("article_id", "text", "TIMESTAMP '2026-10-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, h * 3600) AS published_at")


def test_every_copy_has_a_class_and_a_wire_group(spark):
    base = " ".join(f"w{i}" for i in range(40))
    near, far = base.replace("w39", "x"), base.replace("w0 ", "y ")
    rows = [(1, base, 0.0), (2, base, 10.0), (3, near, 20.0), (4, "other words here and there now", 20.0), (5, None, 20.0), (6, base, 200.0), (7, far, 210.0), (8, base, 230.0)]
    df = dated(spark, rows)
    got = {r.article_id: (r.class_id, r.copies, r.n_links) for r in L.near_dup_classes(df).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 1), 4: (4, 1, 0), 5: (5, 1, 0), 6: (6, 2, 1), 7: (7, 1, 1), 8: (6, 2, 1)}
    # 72 hours pass between 3 and 6, so 6 founds a group of its own
    assert {r.article_id: r.wire_group for r in L.wire_groups(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6}


def test_wire_groups_follow_the_most_similar_earlier_row(spark):
    import random

    rng = random.Random(6)
    rows = []
    for i in range(120):
        old = rng.choice(rows)[1].split() if rows and rng.random() < 0.7 else [f"w{rng.randrange(300)}" for _ in range(30)]
        for _ in range(rng.choice((0, 0, 1, 2))):
            old[rng.randrange(len(old))] = f"v{rng.randrange(300)}"
        rows.append((i, " ".join(old), float(i * 2)))
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(26)} for i, t, _ in rows}
    group = {}
    for i, _, h in rows:  # one row after the other, as they come in
        known = [(len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]), -j) for j, _, g in rows if j < i and h - g <= 72]
        best = max(known, default=(0, 0))
        group[i] = group[-best[1]] if best[0] >= 0.45 else i
    assert {r.article_id: r.wire_group for r in L.wire_groups(dated(spark, rows)).collect()} == group


def test_cycles_of_parents_have_no_root(spark):
    p = spark.createDataFrame([(1, None), (2, 1), (7, 8), (8, 9), (9, 7), (6, 7)], "n long, p long")
    assert {r.n: r.root for r in L.chain_roots(p, "n", "p").collect()} == {1: 1, 2: 1, 7: None, 8: None, 9: None, 6: None}
    a = {(r.node, r.ancestor): r.hops for r in L.ancestors(p.where("p IS NOT NULL"), "n", "p").collect()}
    assert a[(7, 7)] == 3 and a[(6, 9)] == 3 and a[(2, 1)] == 1


def test_chains_longer_than_any_round_limit(spark):
    n = 300
    p = spark.createDataFrame([(i, i - 1) for i in range(1, n)] + [(0, None)], "n long, p long")
    assert {r.root for r in L.chain_roots(p, "n", "p").collect()} == {0}


def test_independence_groups_by_wire_agency_outlet_owner_and_state(spark):
    rows = [(1, 1, "PTI", "X", "o1", None), (2, 2, "PTI", "Y", "o2", None), (3, 3, None, "X", "o1", None), (4, 4, None, "Z", "o3", None), (5, 4, None, "V", "o4", "Russia")]
    df = spark.createDataFrame(rows, "article_id long, wire_group long, agency string, outlet string, owner string, government string")
    shared = ["wire_group", "agency", "outlet", "owner", "government"]
    assert {r.article_id: r.grp for r in C.independence_groups(df, "article_id", shared).collect()} == {1: "g1", 2: "g1", 3: "g1", 4: "gov:russia", 5: "gov:russia"}
    # in two stories, sharing across them binds nobody
    two = df.withColumn("story_id", df.article_id % 2)
    assert {r.article_id: r.grp for r in C.independence_groups(two, "article_id", shared, within=["story_id"]).collect()} == {1: "g1", 2: "g2", 3: "g1", 4: "g4", 5: "gov:russia"}


def told(spark, reports):
    """Claims, articles and attributions of one statement: (outlet, agency, attributed to, text, author)."""
    claims = spark.createDataFrame([(k, 1, 10, k, "attributes" if r[2] else "asserts", r[2] or "article", "none") for k, r in enumerate(reports)], "claim_id long, story_id long, canonical_id long, article_id long, stance string, attributed_to string, evidence string")
    articles = spark.createDataFrame([(1, k, r[0], r[0], r[1], None, r[4], r[3], "full") for k, r in enumerate(reports)], "story_id long, article_id long, outlet string, owner string, agency string, government string, author string, text string, text_source string").selectExpr(
        "*", "TIMESTAMP '2026-10-01 00:00:00' + make_interval(0, 0, 0, 0, 0, article_id) AS published_at"
    )
    known = {"police": ("police", "police", None), "Delhi Police spokesperson": ("Delhi Police", "police", "Delhi"), "Times of India": ("Times of India", "other", None), "Mr Rao": ("Mr Rao", "person", None)}
    attributions = spark.createDataFrame([(r, *known.get(r, (r, None, None))) for r in {r[2] for r in reports if r[2]} | {"article"}], "attributed_to string, name string, kind string, source_government string")
    known_outlets = articles.select("outlet", "owner").union(spark.createDataFrame([("Times of India", "Times of India")], "outlet string, owner string"))
    groups = articles.selectExpr("story_id", "article_id", "concat('g', article_id) AS grp")
    firsts = C.first_and_sole(claims.join(articles.select("article_id", "published_at"), "article_id"), "published_at", keys=["story_id", "article_id"])
    articles = C.article_voices(articles)
    return C.statement_origins(C.claim_origins(claims, articles, C.original_articles(articles, firsts), attributions, known_outlets), groups).first()


def test_origins(spark):
    plain = lambda outlet, agency=None, by=None, text="body", author=None: (outlet, agency, by, text, author)
    # an agency's copy and an attribution to it are one origin
    assert told(spark, [plain("A", "PTI"), plain("B", by="PTI"), plain("C")]).n_origins == 1
    # the police named two ways are one government at most
    assert told(spark, [plain("A", by="police"), plain("B", by="Delhi Police spokesperson"), plain("C")]).origins == "gov:delhi,pool"
    # rewritten notes with bylines are one pool
    assert told(spark, [plain(o, text="Also Read: two people died.", author=a) for o, a in (("A", "Rahul Sharma"), ("B", "Priya Singh"), ("C", "Amit Verma"))]).n_origins == 0
    # another outlet's report counts only if its own article is original
    toi = [plain("A", by="Times of India"), plain("B", by="Times of India"), plain("C", "PTI")]
    assert told(spark, toi).origins == "agency:pti,pool"
    assert told(spark, [*toi, plain("Times of India", text="NEW DELHI: two people died.", author="Rahul Sharma")]).origins == "agency:pti,own:times of india"
    # unnamed people and records add none; a named person does
    assert told(spark, [plain("A", "PTI"), plain("B", by="named witness"), plain("C", by="media report"), plain("D", by="official data"), plain("E", by="Mr Rao")]).origins == "agency:pti,pool,src:mr rao"


def test_verdicts_by_the_established_rule(spark):
    from pyspark.sql import functions as F

    support = spark.createDataFrame(
        [
            (1, "g1,g2,g3", "", "A,B", 3), (2, "g1,g2,g3,g4,g5", "g9", "A", 6), (3, "", "g1", "", 1), (4, "g1,g2,g3", "", "A", 3), (5, "g1,g2,g3", "", "A,B", 3),
            (6, "g1,g2", "", "A,B", 2), (7, "g1,g2,g3", "", "A,B", 3), (8, "g1,g2,g3", "", "A,B", 3), (9, "g1,g2,g3", "", "A,B", 3), (10, "g1", "g2", "A", 9), (11, "g1", "g2", "A", 9), (12, "", "g1", "", 1),
        ],
        "canonical_id long, support_groups string, deny_groups string, support_perspectives string, n_articles long",
    )
    origins = support.selectExpr("canonical_id", "CASE WHEN canonical_id = 7 THEN 1 ELSE 2 END AS n_origins", "size(split(support_groups, ',')) AS n_outlets")
    plain = dict(checkable=True, met_at=None, name_conflict=False, mode=None, old_verdict=None, checked_members=None)
    special = {1: dict(met_at="2026-10-01 01:00:00"), 4: dict(mode="global"), 5: dict(met_at="2026-10-01 02:00:01"), 8: dict(name_conflict=True), 9: dict(checkable=None), 10: dict(old_verdict="false", checked_members=7), 11: dict(old_verdict="false", checked_members=6)}
    rows = [tuple({"canonical_id": i, **plain, **special.get(i, {})}.values()) for i in range(1, 13)]
    statements = spark.createDataFrame(rows, "canonical_id long, checkable boolean, met_at string, name_conflict boolean, mode string, old_verdict string, checked_members long").withColumn("met_at", F.col("met_at").cast("timestamp"))
    conflicts = spark.createDataFrame([(6, 1), (1, 12)], "canonical_id long, other long")
    got = {r.canonical_id: r.verdict for r in C.base_verdict(support, origins, statements, conflicts, F.expr("TIMESTAMP '2026-10-01 08:00:00'")).collect()}
    assert got == {
        1: "corroborated", 2: "disputed", 3: "unverified", 4: "unverified", 5: "developing", 6: "disputed", 7: "unverified", 8: "unverified", 9: "unverified", 10: "false", 11: "disputed", 12: "unverified",
    }


def test_support_counts_the_best_row_of_each_group(spark):
    rows = [(1, 10, 1, "asserts", "official_statement"), (1, 10, 2, "attributes", "fir"), (1, 10, 3, "asserts", "none"), (1, 10, 4, "denies", "video"), (1, 10, 5, "asserts", "named_witness")]
    claims = spark.createDataFrame(rows, "story_id long, canonical_id long, article_id long, stance string, evidence string")
    groups = spark.createDataFrame([(1, 1, "g1"), (1, 2, "g1"), (1, 3, "gov:x"), (1, 4, "g4"), (1, 5, "g5")], "story_id long, article_id long, grp string")
    r = C.support_summary(claims, groups).first()
    assert (r.support_weight, r.support_groups, r.deny_groups, r.n_articles) == (2.0 + 1.0 + 1.5, "g1,g5", "g4", 5)


def test_nearest_in_time_prefers_the_earlier_on_a_tie(spark):
    left = spark.sql("SELECT 1 AS g, 10L AS k, TIMESTAMP '2024-01-01 00:00:10' AS ts")
    right = spark.sql("SELECT 1 AS g, 5L AS v, TIMESTAMP '2024-01-01 00:00:05' AS ts UNION ALL SELECT 1, 6L, TIMESTAMP '2024-01-01 00:00:15'")
    assert L.nearest_in_time(left, right, "g", "k", "ts", "v").first().v == 5


def test_streams_over_many_files_equal_their_batch_twins(spark, tmp_path):
    from pyspark.sql import functions as F

    from attestor.streaming import jobs as J

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events.parquet")
    bounds = [r.c for r in events.select(F.percentile_approx(F.unix_micros("ts"), [i / 12 for i in range(1, 12)], 10000).alias("q")).select(F.explode("q").alias("c")).collect()]
    part = sum((F.when(F.unix_micros("ts") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    for i in range(12):  # files in the order of time, as they come in
        events.where(part == i).coalesce(1).write.mode("append").parquet(path)
    stream = lambda *c: J.event_stream(spark, path, 4).select("user_id", "ts", "event_id", *c)
    rows = sorted(events.select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok")).collect(), key=lambda r: (r.user_id, r.ts, r.event_id))
    fails, gate = {}, {}
    for r in rows:
        run, most = fails.get(r.user_id, (0, 0))
        run = 0 if r.ok else run + 1
        fails[r.user_id] = (run, max(run, most))
        last, n = gate.get(r.user_id, (None, 0))
        if last is None or (r.ts - last).total_seconds() >= 300 * 3600:
            gate[r.user_id] = (r.ts, n + 1)
    ok = (F.col("event_type") != "error").alias("ok")
    got = J.run_to_table(J.failure_counter(stream(ok), "user_id", "ts", "ok", 3), "f", "update", ["user_id"]).collect()
    assert len(got) == len(fails) and {r.user_id: (r.fail_count, r.longest) for r in got} == fails
    got = J.run_to_table(J.run_gate(stream(), "user_id", "ts", 300), "g", "update", ["user_id"]).collect()
    assert {r.user_id: r.runs for r in got} == {u: n for u, (_, n) in gate.items()}
    assert J.run_to_table(J.windowed_counts(stream(), "ts", "1 hour", None, ["user_id"]), "h", "complete").agg(F.sum("n")).first()[0] == len(rows)
    assert J.run_to_table(J.ingest_dedup(stream(), "event_id", "ts").select("event_id"), "d").count() == len({r.event_id for r in rows})


def test_timeline_tiers_and_undated_events(spark):
    from attestor.operators import stories as S

    rows = [(1, 1, 14, 17), (1, 2, 21, 21), (1, 3, 20, 23), (1, 4, None, None), (2, 5, 1, 2)]
    ev = spark.createDataFrame(rows, "story_id long, canonical_id long, a int, b int").selectExpr("story_id", "canonical_id", "TIMESTAMP '2026-10-01 00:00:00' + make_interval(0, 0, 0, 0, a) AS t_start", "TIMESTAMP '2026-10-01 00:00:00' + make_interval(0, 0, 0, 0, b) AS t_end")
    assert {r.canonical_id: r.tier for r in S.timeline_tiers(ev).collect()} == {1: 0, 2: 1, 3: 1, 4: None, 5: 0}
    chain = spark.range(200).selectExpr("7L AS story_id", "id AS canonical_id", "TIMESTAMP '2026-10-01 00:00:00' + make_interval(0, 0, 0, 0, int(id)) AS t_start", "TIMESTAMP '2026-10-01 00:00:00' + make_interval(0, 0, 0, 0, int(id)) AS t_end")
    assert {r.canonical_id: r.tier for r in S.timeline_tiers(chain).collect()} == {i: i for i in range(200)}


def test_merged_statements_never_cross_a_dispute(spark):
    from attestor.operators import stories as S

    rows = [(1, 10, 1, "claim", "short"), (2, 10, 2, "claim", "short"), (3, 11, 1, "event", "a longer text"), (4, 12, 1, "claim", "x"), (5, 13, 1, "claim", "yy"), (6, 13, 2, "claim", "yy")]
    claims = spark.createDataFrame(rows, "claim_id long, canonical_id long, article_id long, kind string, text string")
    pairs = spark.createDataFrame([(11, 10), (12, 13), (12, 11)], "a long, b long")
    got = {r.claim_id: (r.canonical_id, r.kind) for r in S.merge_statements(claims, pairs, spark.createDataFrame([(11, 12)], "a long, b long")).collect()}
    assert got == {1: (10, "event"), 2: (10, "event"), 3: (10, "event"), 4: (13, "claim"), 5: (13, "claim"), 6: (13, "claim")}
