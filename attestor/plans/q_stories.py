"""Queries of stories, sides, clusters, timelines and statement consolidation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.operators import corroboration as C

from attestor.operators import linking as L
from attestor.operators import stories as S
from attestor.operators.timeline import ordered_timeline
from attestor.plans.q_corroboration import MATRIX, OWNERS, owners
from attestor.plans.q_linking import TOPK
from attestor.plans.registry import query
from attestor.plans.tables import Tables


@query("story_core", """WITH r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings), s AS (SELECT a.label, a.vec_id, a.i, round(sum(list_cosine_similarity(a.e, b.e)), 9) AS s FROM r a JOIN r b ON a.label = b.label AND a.i <= 3 AND b.i <= 3 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, i) AS rn FROM s) SELECT label, vec_id AS core FROM k WHERE rn = 1""")
def _(t: Tables):
    return S.story_core(t.embeddings, "label", "vec_id", "vec_id", "embedding")


@query("story_assign", f"WITH {TOPK}, m AS (SELECT k.vec_id, e.label, cosine, row_number() OVER (PARTITION BY k.vec_id, e.label ORDER BY cosine DESC, other) AS r FROM k JOIN embeddings e ON e.vec_id = k.other WHERE rank <= 40), s AS (SELECT vec_id, label, round(avg(cosine), 6) AS top2 FROM m WHERE r <= 2 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY top2 DESC, label) AS rn FROM s) SELECT vec_id, CASE WHEN top2 >= 0.2 THEN label END AS label, CASE WHEN top2 >= 0.3 THEN 'join' WHEN top2 >= 0.2 THEN 'ask' ELSE 'new' END AS action FROM b WHERE rn = 1")
def _(t: Tables):
    k = L.cosine_topk(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id").join(t.embeddings.select(F.col("vec_id").alias("other"), "label"), "other")
    m = k.withColumn("r", F.row_number().over(W.partitionBy("vec_id", "label").orderBy(F.desc("cosine"), "other"))).where("r <= 2")
    return S.snapshot_assign(m.groupBy("vec_id", "label").agg(F.round(F.avg("cosine"), 6).alias("top2")), "vec_id", "label", 0.3, 0.2)


@query("story_split")
def _(t: Tables):
    v = t.embeddings.select((F.col("vec_id") % 50).alias("story_id"), "vec_id", F.concat(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 3.0).otherwise(0.0).cast("float")), F.col("embedding")).alias("v"))
    return S.story_split(v, "story_id", "vec_id", "v")


@query("two_sided_split")
def _(t: Tables):
    return S.two_sided(C.pairwise_agreement(C.stance_matrix(t.v_claims, owners(t))))


@query("perspective_label", f"WITH {OWNERS}, {MATRIX} SELECT story_id, grp, CASE WHEN avg(stance) > 0.3 THEN 'A' WHEN avg(stance) < -0.1 THEN 'B' END AS label FROM mx GROUP BY ALL")
def _(t: Tables):
    m = C.stance_matrix(t.v_claims, owners(t)).groupBy("story_id", "grp").agg(F.avg("stance").alias("s"))
    return m.select("story_id", "grp", F.when(F.col("s") > 0.3, "A").when(F.col("s") < -0.1, "B").alias("label"))


@query("article_departure", """WITH r AS (SELECT article_id, article_id % 3 AS own, canonical_id % 3 AS cluster, CASE stance WHEN 'asserts' THEN 1.0 WHEN 'attributes' THEN 0.5 ELSE -1.0 END AS v FROM v_claims), m AS (SELECT article_id, own, cluster, avg(v)::DOUBLE AS m, count(*) AS n FROM r GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY m DESC, cluster) AS rn FROM m WHERE own <> cluster AND n >= 3 AND m > 0) SELECT o.article_id, o.cluster AS "to" FROM o LEFT JOIN m ON m.article_id = o.article_id AND m.own = m.cluster WHERE rn = 1 AND o.m - coalesce(m.m, 0) >= 0.05""")
def _(t: Tables):
    r = t.v_claims.select("article_id", (F.col("article_id") % 3).alias("own"), (F.col("canonical_id") % 3).alias("cluster"), C.mapped("stance", C.STANCE).alias("v"))
    return S.departures(r, "article_id", "own", "cluster", "v", 0.05)


@query("cluster_stability", """WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS n FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS ra FROM (SELECT sum(n) AS n FROM c GROUP BY quality)), b AS (SELECT sum(n * (n - 1) / 2) AS rb FROM (SELECT sum(n) AS n FROM c GROUP BY toxic))
SELECT round(((x - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)))::DOUBLE, 9) AS ari FROM x, a, b""")
def _(t: Tables):
    return S.adjusted_rand(t.labels, "quality", "toxic").select(F.round("ari", 9).alias("ari"))


EV = "ev AS (SELECT story_id, canonical_id, min(t_start) AS s, max(t_end) AS e FROM v_claims WHERE kind = 'event' GROUP BY ALL)"


@query("timeline_tiers", f"WITH RECURSIVE {EV}, k AS (SELECT story_id, min(e) AS e FROM ev GROUP BY story_id UNION ALL SELECT k.story_id, (SELECT min(ev.e) FROM ev WHERE ev.story_id = k.story_id AND ev.s > k.e) FROM k WHERE k.e IS NOT NULL) SELECT canonical_id, count(k.e) AS tier FROM ev LEFT JOIN k ON ev.story_id = k.story_id AND k.e < ev.s GROUP BY canonical_id")
def _(t: Tables):
    ev = t.v_claims.where("kind = 'event'").groupBy("story_id", "canonical_id").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
    return S.timeline_tiers(ev).select("canonical_id", "tier")


@query("timeline_relations")
def _(t: Tables):
    ev = t.v_claims.where("kind = 'event'").groupBy("story_id", "canonical_id").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
    tiers, dropped = ordered_timeline(ev, t.v_relations)
    lost = dropped.groupBy("story_id", F.col("earlier").alias("canonical_id")).agg(F.count(F.lit(1)).alias("dropped"))
    return tiers.join(lost, ["story_id", "canonical_id"], "left").select("canonical_id", "tier", F.coalesce("dropped", F.lit(0)).alias("dropped"))


@query("claim_match_arrival", """SELECT claim_id, min(claim_id) OVER (PARTITION BY story_id, attributed_to, evidence, loaded_word) AS founder, max(kind) OVER (PARTITION BY story_id, attributed_to, evidence, loaded_word) AS kind FROM v_claims""")
def _(t: Tables):
    w = W.partitionBy("story_id", "attributed_to", "evidence", "loaded_word")
    return t.v_claims.select("claim_id", F.min("claim_id").over(w).alias("founder"), F.max("kind").over(w).alias("kind"))


@query("statement_merge_apply", """WITH st AS (SELECT canonical_id, (canonical_id // 3) * 3 AS g, count(DISTINCT article_id) AS n, max(length(loaded_word)) AS l, bool_or(kind = 'event') AS ev FROM v_claims GROUP BY ALL),
pr AS (SELECT a.canonical_id AS a, a.g AS b FROM st a JOIN st b ON a.g = b.canonical_id WHERE a.canonical_id <> a.g AND NOT (a.g % 9 = 0 AND a.canonical_id = a.g + 1)), gr AS (SELECT st.*, coalesce(pr.b, st.canonical_id) AS c FROM st LEFT JOIN pr ON st.canonical_id = pr.a),
bs AS (SELECT c, arg_min(canonical_id, (-n, -l, canonical_id)) AS best, bool_or(ev) AS ev FROM gr GROUP BY c) SELECT claim_id, best AS canonical_id, CASE WHEN bs.ev THEN 'event' ELSE kind END AS kind FROM v_claims v JOIN gr ON v.canonical_id = gr.canonical_id JOIN bs ON gr.c = bs.c""")
def _(t: Tables):
    claims = t.v_claims.withColumn("text", F.col("loaded_word"))
    a = claims.select(F.col("canonical_id").alias("a")).distinct()
    same = a.withColumn("b", F.expr("a div 3") * 3).where("a <> b").join(a.select(F.col("a").alias("b")), "b", "left_semi")
    apart = a.where("a % 9 = 0").select("a", (F.col("a") + 1).alias("b"))
    return S.merge_statements(claims, same, apart)


@query("alias_repair", "SELECT canonical_id, arg_min(attributed_to, claim_id) AS first_text FROM v_claims GROUP BY canonical_id")
def _(t: Tables):
    return t.v_claims.groupBy("canonical_id").agg(F.min_by("attributed_to", "claim_id").alias("first_text"))


@query("fold_covered", """WITH m AS (SELECT canonical_id, (canonical_id // 10) * 10 AS big FROM (SELECT DISTINCT canonical_id FROM v_claims)) SELECT m.big AS canonical_id, count(DISTINCT c.article_id) AS n_articles, count(DISTINCT m.canonical_id) AS folded FROM v_claims c JOIN m ON c.canonical_id = m.canonical_id GROUP BY m.big""")
def _(t: Tables):
    m = t.v_claims.withColumn("big", F.expr("canonical_id div 10") * 10)
    return m.groupBy(F.col("big").alias("canonical_id")).agg(F.count_distinct("article_id").alias("n_articles"), F.count_distinct("canonical_id").alias("folded"))


@query("verify_candidates", """SELECT canonical_id, n FROM (SELECT canonical_id, count(DISTINCT article_id) AS n, count(*) FILTER (stance = 'denies') AS d FROM v_claims GROUP BY canonical_id) WHERE n >= 2 AND d > 0 ORDER BY n DESC, canonical_id LIMIT 200""")
def _(t: Tables):
    s = t.v_claims.groupBy("canonical_id").agg(F.count_distinct("article_id").alias("n"), F.count_if(F.col("stance") == "denies").alias("d"))
    return s.where("n >= 2 AND d > 0").orderBy(F.desc("n"), "canonical_id").limit(200).select("canonical_id", "n")


@query("two_model_verdict", """WITH o AS (SELECT canonical_id, CASE WHEN sum(l) % 3 = 0 THEN 'confirmed' WHEN sum(l) % 3 = 1 THEN 'false' ELSE 'unsure' END AS a, CASE WHEN sum(l) % 2 = 0 THEN 'confirmed' ELSE 'false' END AS b, bool_or(evidence IN ('video', 'court_record')) AS prim FROM (SELECT *, claim_id % 10 AS l FROM v_claims) GROUP BY canonical_id) SELECT canonical_id, CASE WHEN a = b AND prim THEN a ELSE 'keep' END AS verdict FROM o""")
def _(t: Tables):
    s = t.v_claims.groupBy("canonical_id").agg(F.sum(F.col("claim_id") % 10).alias("l"), F.bool_or(F.col("evidence").isin("video", "court_record")).alias("prim"))
    a = F.when(F.col("l") % 3 == 0, "confirmed").when(F.col("l") % 3 == 1, "false").otherwise("unsure")
    b = F.when(F.col("l") % 2 == 0, "confirmed").otherwise("false")
    return s.select("canonical_id", F.when((a == b) & F.col("prim"), a).otherwise("keep").alias("verdict"))


@query("mature_pages", """WITH s AS (SELECT story_id, md5(string_agg(concat(canonical_id::VARCHAR, ':', n::VARCHAR), ',' ORDER BY canonical_id)) AS sig, md5(string_agg(concat(canonical_id::VARCHAR, ':', (CASE WHEN story_id % 5 = 0 THEN n + 1 ELSE n END)::VARCHAR), ',' ORDER BY canonical_id)) AS old FROM (SELECT story_id, canonical_id, count(*) AS n FROM v_claims GROUP BY ALL) GROUP BY story_id) SELECT story_id FROM s WHERE sig <> old""")
def _(t: Tables):
    n = t.v_claims.groupBy("story_id", "canonical_id").agg(F.count(F.lit(1)).alias("n"))
    sig = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("canonical_id", c.alias("n")))), lambda x: F.concat(x["canonical_id"].cast("string"), F.lit(":"), x["n"].cast("string"))), ","))
    s = n.groupBy("story_id").agg(sig(F.col("n")).alias("sig"), sig(F.when(F.col("story_id") % 5 == 0, F.col("n") + 1).otherwise(F.col("n"))).alias("old"))
    return s.where("sig <> old").select("story_id")


@query("followup_gate", """WITH s AS (SELECT story_id, count(DISTINCT canonical_id) AS n, count(DISTINCT article_id) AS g FROM v_claims WHERE kind = 'event' GROUP BY story_id) SELECT l.child_id, c.n >= greatest(4, ceil(0.5 * p.n)) AND c.g >= 3 AS ok FROM v_links l JOIN s c ON c.story_id = l.child_id JOIN s p ON p.story_id = l.parent_id""")
def _(t: Tables):
    s = t.v_claims.where("kind = 'event'").groupBy("story_id").agg(F.count_distinct("canonical_id").alias("n"), F.count_distinct("article_id").alias("g"))
    c = s.select(F.col("story_id").alias("child_id"), "n", "g")
    p = s.select(F.col("story_id").alias("parent_id"), F.col("n").alias("m"))
    return t.v_links.join(c, "child_id").join(p, "parent_id").select("child_id", ((F.col("n") >= F.greatest(F.lit(4), F.ceil(0.5 * F.col("m")))) & (F.col("g") >= 3)).alias("ok"))


@query("speaker_groups", """SELECT canonical_id, attributed_to, row_number() OVER (PARTITION BY canonical_id ORDER BY f) AS pos FROM (SELECT canonical_id, attributed_to, min(claim_id) AS f FROM v_claims WHERE stance <> 'denies' GROUP BY ALL)""")
def _(t: Tables):
    f = t.v_claims.where("stance <> 'denies'").groupBy("canonical_id", "attributed_to").agg(F.min("claim_id").alias("f"))
    return f.select("canonical_id", "attributed_to", F.row_number().over(W.partitionBy("canonical_id").orderBy("f")).alias("pos"))


@query("flow_stats", r"""WITH x AS (SELECT conv_id, turn, regexp_extract(text, '^(\S+\s+\S+)', 1) AS two, len(regexp_extract_all(text, '\S+')) AS n FROM conversations), y AS (SELECT *, two = lag(two) OVER (PARTITION BY conv_id ORDER BY turn) AS same FROM x) SELECT conv_id, count(*) FILTER (same) AS repeats, count(*) FILTER (n > 45) AS long_ones FROM y GROUP BY conv_id""")
def _(t: Tables):
    x = t.conversations.select("conv_id", "turn", F.regexp_extract("text", r"^(\S+\s+\S+)", 1).alias("two"), F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n"))
    y = x.withColumn("same", F.col("two") == F.lag("two").over(W.partitionBy("conv_id").orderBy("turn")))
    return y.groupBy("conv_id").agg(F.count_if("same").alias("repeats"), F.count_if(F.col("n") > 45).alias("long_ones"))


@query("sentence_grounding_check", r"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM conversations) SELECT conv_id, turn, CASE WHEN src IS NULL THEN 'first' WHEN len(regexp_extract_all(text, '\S+')) > 60 THEN 'long' WHEN regexp_matches(lower(text), '\bnot\b') AND NOT regexp_matches(lower(src), '\bnot\b') THEN 'negation' WHEN regexp_matches(text, '\d') AND NOT regexp_matches(src, '\d') THEN 'number' ELSE 'ok' END AS reason FROM p""")
def _(t: Tables):
    p = t.conversations.withColumn("src", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")))
    reason = (
        F.when(F.col("src").isNull(), "first")
        .when(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) > 60, "long")
        .when(F.lower("text").rlike(r"\bnot\b") & ~F.lower("src").rlike(r"\bnot\b"), "negation")
        .when(F.col("text").rlike(r"\d") & ~F.col("src").rlike(r"\d"), "number")
        .otherwise("ok")
    )
    return p.select("conv_id", "turn", reason.alias("reason"))


@query("resolve_covered", """WITH RECURSIVE p AS (SELECT o_orderkey AS n, (o_orderkey // 3)::BIGINT AS p FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey // 3 > 0), r AS (SELECT n, p, 1 AS d FROM p UNION ALL SELECT r.n, p.p, d + 1 FROM r JOIN p ON r.p = p.n), k AS (SELECT n, arg_max(p, d) AS root FROM r GROUP BY n) SELECT n, root FROM k""")
def _(t: Tables):
    p = t.orders.where("o_orderkey % 4 <> 0 AND o_orderkey div 3 > 0").select(F.col("o_orderkey").alias("n"), F.expr("o_orderkey div 3").alias("p"))
    ends = p.select(F.col("p").alias("n")).join(p.select("n"), "n", "left_anti").distinct().withColumn("p", F.lit(None).cast("long"))
    return L.chain_roots(p.unionByName(ends), "n", "p").join(p.select("n"), "n", "left_semi")


@query("followup_redirect", "SELECT child_id, min(parent_id) AS story FROM v_links WHERE parent_id % 2 = 1 GROUP BY child_id")
def _(t: Tables):
    return t.v_links.where("parent_id % 2 = 1").groupBy("child_id").agg(F.min("parent_id").alias("story"))


@query("dispute_gate", """WITH p AS (SELECT a.canonical_id AS a, b.canonical_id AS b, a.n AS x, b.n AS y FROM (SELECT story_id, canonical_id, count(*) FILTER (stance = 'denies') AS n FROM v_claims GROUP BY ALL) a JOIN (SELECT story_id, canonical_id, count(*) FILTER (stance = 'denies') AS n FROM v_claims GROUP BY ALL) b ON a.story_id = b.story_id AND a.canonical_id + 1 = b.canonical_id) SELECT a, b, CASE WHEN x >= 2 AND y >= 2 THEN 'dispute' WHEN x + y > 0 THEN 'doubtful' ELSE 'none' END AS gate FROM p""")
def _(t: Tables):
    n = t.v_claims.groupBy("story_id", "canonical_id").agg(F.count_if(F.col("stance") == "denies").alias("n"))
    a = n.select("story_id", F.col("canonical_id").alias("a"), (F.col("canonical_id") + 1).alias("b"), F.col("n").alias("x"))
    b = n.select("story_id", F.col("canonical_id").alias("b"), F.col("n").alias("y"))
    p = a.join(b, ["story_id", "b"])
    return p.select("a", "b", F.when((F.col("x") >= 2) & (F.col("y") >= 2), "dispute").when(F.col("x") + F.col("y") > 0, "doubtful").otherwise("none").alias("gate"))


