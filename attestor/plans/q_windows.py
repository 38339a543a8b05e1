"""Queries of windows, sorts, limits, set operations and rollups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.operators import intake as I
from attestor.plans.registry import query
from attestor.plans.tables import Tables


@query("stall_window", """SELECT started_at, sum(ingested) OVER w > 0 AND max(grouped_n) OVER w = 0 AS stalled FROM v_runs WINDOW w AS (ORDER BY started_at ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(t: Tables):
    w = W.orderBy("started_at").rowsBetween(-2, 0)  # one row for each run
    return t.v_runs.select("started_at", ((F.sum("ingested").over(w) > 0) & (F.max("grouped_n").over(w) == 0)).alias("stalled"))


@query("writer_silence", """SELECT log_id, ok = 0 AND lag(ok) OVER (PARTITION BY feed_id ORDER BY ts, log_id) IS NOT DISTINCT FROM 0 AS silent FROM v_feed_log""")
def _(t: Tables):
    w = W.partitionBy("feed_id").orderBy("ts", "log_id")
    return t.v_feed_log.select("log_id", ((F.col("ok") == 0) & F.lag("ok").over(w).eqNullSafe(F.lit(0))).alias("silent"))


@query("hour_seats", """SELECT article_id, seat FROM (SELECT article_id, agency, row_number() OVER (PARTITION BY date_trunc('hour', published_at), agency IS NULL ORDER BY n_chars DESC, article_id) AS seat FROM v_articles) WHERE seat <= CASE WHEN agency IS NULL THEN 2 ELSE 1 END""")
def _(t: Tables):
    w = W.partitionBy(F.date_trunc("hour", "published_at"), F.col("agency").isNull()).orderBy(F.desc("n_chars"), "article_id")
    return t.v_articles.withColumn("seat", F.row_number().over(w)).where(F.col("seat") <= F.when(F.col("agency").isNull(), 2).otherwise(1)).select("article_id", "seat")


@query("prefix_timing", """SELECT conv_id, turn, coalesce(sum(length(text) + 12) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS starts FROM conversations""")
def _(t: Tables):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 12).over(w), F.lit(0)).cast("long").alias("starts"))


@query("greedy_chunking", """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), r AS (SELECT conv_id, turn, i, n, 1 AS chunk FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.turn, o.i, CASE WHEN r.n + o.n <= 400 THEN r.n + o.n ELSE o.n END, CASE WHEN r.n + o.n <= 400 THEN r.chunk ELSE r.chunk + 1 END FROM r JOIN o ON o.conv_id = r.conv_id AND o.i = r.i + 1) SELECT conv_id, turn, chunk FROM r""")
def _(t: Tables):
    items = F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("c"), F.array().cast("array<struct<turn:bigint,chunk:int>>").alias("out"))

    def step(acc, x):
        fits = (acc["n"] + x["n"] <= 400) | (acc["n"] == 0)
        chunk = F.when(fits, acc["c"]).otherwise(acc["c"] + 1)
        return F.struct(F.when(fits, acc["n"] + x["n"]).otherwise(x["n"]).alias("n"), chunk.alias("c"), F.array_append(acc["out"], F.struct(x["turn"].alias("turn"), chunk.alias("chunk"))).alias("out"))

    folded = t.conversations.groupBy("conv_id").agg(items.alias("x")).select("conv_id", F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("y"))
    return folded.select("conv_id", "y.turn", "y.chunk")


@query("source_numbering", """SELECT canonical_id, attributed_to, row_number() OVER (PARTITION BY canonical_id ORDER BY f, attributed_to) AS number FROM (SELECT canonical_id, attributed_to, min(claim_id) AS f FROM v_claims GROUP BY ALL)""")
def _(t: Tables):
    f = t.v_claims.groupBy("canonical_id", "attributed_to").agg(F.min("claim_id").alias("f"))
    return f.select("canonical_id", "attributed_to", F.row_number().over(W.partitionBy("canonical_id").orderBy("f", "attributed_to")).alias("number"))


@query("budget_pacing", """WITH h AS (SELECT ts::DATE AS day, hour(ts) AS h, count(*) AS used FROM v_feed_log GROUP BY ALL), w AS (SELECT *, sum(CASE WHEN h BETWEEN 2 AND 17 THEN 1.5 ELSE 0.5 END) OVER (PARTITION BY day ORDER BY h) AS open FROM h) SELECT day, h, used, round((open / 28.0)::DOUBLE, 6) AS share FROM w""")
def _(t: Tables):
    h = t.v_feed_log.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("used"))
    w = F.when(F.col("h").between(2, 17), F.lit(1.5)).otherwise(F.lit(0.5))
    return h.withColumn("share", F.round(F.sum(w).over(W.partitionBy("day").orderBy("h")) / 28.0, 6))


@query("embed_queue_pick", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY agency IS NULL ORDER BY published_at DESC, article_id) AS rn FROM v_articles), n AS (SELECT count(*) FILTER (agency IS NULL) AS a, count(*) FILTER (agency IS NOT NULL) AS b FROM v_articles) SELECT article_id FROM r, n WHERE CASE WHEN agency IS NULL THEN rn <= 100 + greatest(0, 100 - b) ELSE rn <= 100 + greatest(0, 100 - a) END""")
def _(t: Tables):
    a = t.v_articles
    n = a.agg(F.count_if(F.col("agency").isNull()).alias("a"), F.count_if(F.col("agency").isNotNull()).alias("b"))
    ranked = I.cap_per_group(a.withColumn("plain", F.col("agency").isNull()), ["plain"], [F.col("published_at").desc(), F.col("article_id")], 200)
    joined = ranked.join(F.broadcast(n), F.lit(True))  # one row of counts
    return joined.where(F.col("rank") <= 100 + F.greatest(F.lit(0), 100 - F.when(F.col("plain"), F.col("b")).otherwise(F.col("a")))).select("article_id")


@query("coverage_rank", """SELECT story_id, round(0.25 * least(count(DISTINCT owner), 6) + CASE WHEN count(DISTINCT lang) >= 2 THEN 0.5 ELSE 0 END + avg(n_chars) / 10000, 2)::DOUBLE AS value FROM v_articles GROUP BY story_id""")
def _(t: Tables):
    return t.v_articles.groupBy("story_id").agg(F.round(F.lit(0.25) * F.least(F.count_distinct("owner"), F.lit(6)) + F.when(F.count_distinct("lang") >= 2, 0.5).otherwise(0.0) + F.avg("n_chars") / 10000, 2).alias("value"))


@query("reserved_slot_topk", """WITH v AS (SELECT story_id, count(DISTINCT owner) AS value, bool_or(government IS NOT NULL) AS beat FROM v_articles GROUP BY story_id), k AS (SELECT story_id FROM v WHERE beat ORDER BY value DESC, story_id LIMIT 4),
r AS (SELECT story_id FROM v WHERE story_id NOT IN (SELECT story_id FROM k) ORDER BY value DESC, story_id LIMIT 16 - (SELECT count(*) FROM k)) SELECT story_id FROM k UNION ALL SELECT story_id FROM r""")
def _(t: Tables):
    v = t.v_articles.groupBy("story_id").agg(F.count_distinct("owner").alias("value"), F.bool_or(F.col("government").isNotNull()).alias("beat"))
    order = [F.desc("value"), F.col("story_id")]
    top = v.orderBy(*order).limit(16).withColumn("kept", F.lit(False)).unionByName(v.where("beat").orderBy(*order).limit(4).withColumn("kept", F.lit(True)))
    each = top.groupBy("story_id", "value").agg(F.max("kept").alias("kept"))  # 20 rows at most: the reserved places, then the best of the rest
    return each.orderBy(F.desc("kept"), *order).limit(16).select("story_id")


@query("desk_order", """SELECT story_id, row_number() OVER (ORDER BY (last_at >= TIMESTAMP '2024-01-02 00:00:00') DESC, n DESC, story_id) AS place FROM (SELECT story_id, max(published_at) AS last_at, count(DISTINCT owner) AS n FROM v_articles GROUP BY story_id) ORDER BY place LIMIT 50""")
def _(t: Tables):
    s = t.v_articles.groupBy("story_id").agg(F.max("published_at").alias("last_at"), F.count_distinct("owner").alias("n"))
    top = s.orderBy(F.desc(F.col("last_at") >= F.expr("TIMESTAMP '2024-01-02 00:00:00'")), F.desc("n"), "story_id").limit(50)
    return top.select("story_id", F.row_number().over(W.orderBy(F.desc(F.col("last_at") >= F.expr("TIMESTAMP '2024-01-02 00:00:00'")), F.desc("n"), "story_id")).alias("place"))


@query("search_target_pick", """WITH s AS (SELECT story_id, count(*) AS n, count(DISTINCT owner) AS g, bool_or(government IS NOT NULL) AS gov, max(published_at) AS last_at FROM v_articles GROUP BY story_id), v AS (SELECT story_id, round(ln(1 + n) + 0.6 * g + CASE WHEN gov THEN 1 ELSE 0 END + greatest(0, 2 - (epoch(TIMESTAMP '2024-01-03 00:00:00') - epoch(last_at)) / 43200.0), 4)::DOUBLE AS importance FROM s) SELECT * FROM v ORDER BY importance DESC, story_id LIMIT 20""")
def _(t: Tables):
    s = t.v_articles.groupBy("story_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("owner").alias("g"), F.bool_or(F.col("government").isNotNull()).alias("gov"), F.max("published_at").alias("last_at"))
    age = (F.unix_timestamp(F.expr("TIMESTAMP '2024-01-03 00:00:00'")) - F.unix_timestamp("last_at")) / 43200.0
    v = F.round(F.log(1 + F.col("n")) + 0.6 * F.col("g") + F.when(F.col("gov"), 1).otherwise(0) + F.greatest(F.lit(0.0), 2 - age), 4)
    return s.select("story_id", v.alias("importance")).orderBy(F.desc("importance"), "story_id").limit(20)


@query("work_order", "SELECT story_id, count(*) FILTER (text_source = 'full') AS reads FROM v_articles GROUP BY story_id ORDER BY reads DESC, story_id LIMIT 100")
def _(t: Tables):
    return t.v_articles.groupBy("story_id").agg(F.count_if(F.col("text_source") == "full").alias("reads")).orderBy(F.desc("reads"), "story_id").limit(100)


@query("story_list_topn", "SELECT story_id, max(published_at) AS updated FROM v_articles WHERE lang = 'en' GROUP BY story_id ORDER BY updated DESC, story_id LIMIT 30")
def _(t: Tables):
    return t.v_articles.where("lang = 'en'").groupBy("story_id").agg(F.max("published_at").alias("updated")).orderBy(F.desc("updated"), "story_id").limit(30)


@query("story_health_topk", "SELECT story_id, count(*) AS n, count(*) > 80 AS alarm FROM v_claims GROUP BY story_id ORDER BY n DESC, story_id LIMIT 5")
def _(t: Tables):
    return t.v_claims.groupBy("story_id").agg(F.count(F.lit(1)).alias("n")).withColumn("alarm", F.col("n") > 80).orderBy(F.desc("n"), "story_id").limit(5)


@query("reading_order", """SELECT canonical_id, row_number() OVER (PARTITION BY story_id ORDER BY CASE kind WHEN 'event' THEN 0 ELSE 1 END, first_at, -n, canonical_id) AS place FROM (SELECT story_id, canonical_id, min(kind) AS k0, max(kind) AS kind, min(t_start) AS first_at, count(*) AS n FROM v_claims GROUP BY story_id, canonical_id)""")
def _(t: Tables):
    s = t.v_claims.groupBy("story_id", "canonical_id").agg(F.max("kind").alias("kind"), F.min("t_start").alias("first_at"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("story_id").orderBy(F.when(F.col("kind") == "event", 0).otherwise(1), "first_at", -F.col("n"), "canonical_id")
    return s.select("canonical_id", F.row_number().over(w).alias("place"))


@query("answer_cache_except", "SELECT DISTINCT loaded_word FROM v_claims WHERE stance = 'denies' EXCEPT SELECT loaded_word FROM v_claims WHERE evidence = 'video' AND story_id < 100")
def _(t: Tables):
    c = t.v_claims
    return c.where("stance = 'denies'").select("loaded_word").distinct().join(c.where("evidence = 'video' AND story_id < 100").select("loaded_word").distinct(), "loaded_word", "left_anti")


@query("merge_pair_intersect", "SELECT story_id, canonical_id FROM v_claims WHERE stance = 'asserts' INTERSECT SELECT story_id, canonical_id FROM v_claims WHERE stance = 'denies'")
def _(t: Tables):
    c = t.v_claims.select("story_id", "canonical_id", "stance")
    return c.where("stance = 'asserts'").drop("stance").intersect(c.where("stance = 'denies'").drop("stance"))


@query("array_set_ops", """WITH a AS (SELECT story_id, list_distinct(list(canonical_id) FILTER (stance = 'denies')) AS x, list_distinct(list(canonical_id) FILTER (stance = 'asserts')) AS y FROM v_claims GROUP BY story_id)
SELECT story_id, len(list_distinct(list_concat(coalesce(x, []), coalesce(y, []))))::INT AS both_n, len(list_filter(coalesce(x, []), lambda v: NOT list_contains(coalesce(y, []), v)))::INT AS only_denied FROM a""")
def _(t: Tables):
    a = t.v_claims.groupBy("story_id").agg(F.collect_set(F.when(F.col("stance") == "denies", F.col("canonical_id"))).alias("x"), F.collect_set(F.when(F.col("stance") == "asserts", F.col("canonical_id"))).alias("y"))
    return a.select("story_id", F.size(F.array_union("x", "y")).alias("both_n"), F.size(F.array_except("x", "y")).alias("only_denied"))


@query("bar_counts", """SELECT story_id, count(*) FILTER (evidence = 'none') AS none, count(*) FILTER (evidence = 'video') AS video, count(*) FILTER (evidence = 'court_record') AS court_record FROM v_claims GROUP BY story_id""")
def _(t: Tables):
    p = t.v_claims.groupBy("story_id").pivot("evidence", ["none", "video", "court_record"]).count()
    return p.na.fill(0)


@query("established_share", "SELECT story_id, round(100.0 * count(*) FILTER (stance = 'asserts') / count(*))::INT AS share FROM v_claims GROUP BY story_id")
def _(t: Tables):
    return t.v_claims.groupBy("story_id").agg(F.round(100.0 * F.count_if(F.col("stance") == "asserts") / F.count(F.lit(1))).cast("int").alias("share"))


@query("top_speaker", """SELECT story_id, attributed_to FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, length(attributed_to), attributed_to) AS rn FROM (SELECT story_id, attributed_to, count(*) AS n FROM v_claims GROUP BY story_id, attributed_to)) WHERE rn = 1""")
def _(t: Tables):
    n = t.v_claims.groupBy("story_id", "attributed_to").agg(F.count(F.lit(1)).alias("n"))
    return I.first_by(n, ["story_id"], [F.desc("n"), F.length("attributed_to"), F.col("attributed_to")]).select("story_id", "attributed_to")


@query("default_picture_exclusion", """WITH p AS (SELECT l_orderkey AS story, l_partkey % 50 AS pic, l_linenumber AS ord FROM lineitem), bad AS (SELECT pic FROM p GROUP BY pic HAVING count(DISTINCT story) >= 1200) SELECT story, arg_min(pic, (ord, pic)) AS pic FROM p WHERE pic NOT IN (SELECT pic FROM bad) GROUP BY story""")
def _(t: Tables):
    p = t.lineitem.select(F.col("l_orderkey").alias("story"), (F.col("l_partkey") % 50).alias("pic"), F.col("l_linenumber").alias("ord"))
    bad = p.groupBy("pic").agg(F.count_distinct("story").alias("n")).where("n >= 1200").select("pic")
    return p.join(bad, "pic", "left_anti").groupBy("story").agg(F.min_by("pic", F.struct("ord", "pic")).alias("pic"))


@query("candidate_rollup", """SELECT story_id, count(DISTINCT owner) AS groups, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, bool_or(government IS NOT NULL) AS home, list_min(list(title)) AS title FROM v_articles GROUP BY story_id""")
def _(t: Tables):
    return t.v_articles.groupBy("story_id").agg(F.count_distinct("owner").alias("groups"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), F.bool_or(F.col("government").isNotNull()).alias("home"), F.min("title").alias("title"))


@query("thread_daily_rollup", """SELECT outlet, day, article_id FROM (SELECT outlet, published_at::DATE AS day, arg_max(article_id, (published_at, article_id)) AS article_id FROM v_articles GROUP BY ALL)""")
def _(t: Tables):
    return t.v_articles.groupBy("outlet", F.to_date("published_at").alias("day")).agg(F.max_by("article_id", F.struct("published_at", "article_id")).alias("article_id"))


@query("evidence_vote_two_sided", """SELECT canonical_id FROM v_claims JOIN v_outlets USING (article_id) GROUP BY canonical_id HAVING count(DISTINCT CASE WHEN stance = 'asserts' THEN outlet END) >= 2 AND count(DISTINCT CASE WHEN stance = 'denies' THEN outlet END) = 0""")
def _(t: Tables):
    side = lambda s: F.count_distinct(F.when(F.col("stance") == s, F.col("outlet")))
    v = t.v_claims.join(t.v_outlets, "article_id").groupBy("canonical_id").agg(side("asserts").alias("p"), side("denies").alias("q"))
    return v.where("p >= 2 AND q = 0").select("canonical_id")


@query("invariant_audit", """SELECT 'few outlets' AS chk, canonical_id AS key FROM v_claims WHERE stance = 'asserts' GROUP BY canonical_id HAVING count(DISTINCT article_id) < 2 UNION ALL SELECT 'summary with claims', a.article_id FROM v_articles a WHERE text_source = 'summary' AND article_id IN (SELECT article_id FROM v_claims) UNION ALL SELECT 'failing feed', feed_id FROM v_feed_log GROUP BY feed_id HAVING avg(ok) < 0.75""")
def _(t: Tables):
    c, a, log = t.v_claims, t.v_articles, t.v_feed_log
    one = c.where("stance = 'asserts'").groupBy("canonical_id").agg(F.count_distinct("article_id").alias("n")).where("n < 2").select(F.lit("few outlets").alias("chk"), F.col("canonical_id").alias("key"))
    two = a.where("text_source = 'summary'").join(c.select("article_id").distinct(), "article_id", "left_semi").select(F.lit("summary with claims").alias("chk"), F.col("article_id").alias("key"))
    three = log.groupBy("feed_id").agg(F.avg("ok").alias("r")).where("r < 0.75").select(F.lit("failing feed").alias("chk"), F.col("feed_id").alias("key"))
    return one.unionByName(two).unionByName(three)


@query("coverage_ratio", """SELECT story_id, round((count(DISTINCT CASE WHEN kind = 'claim' THEN canonical_id END)::DOUBLE / count(DISTINCT canonical_id)), 6) AS ratio FROM v_claims GROUP BY story_id""")
def _(t: Tables):
    return t.v_claims.groupBy("story_id").agg(F.round(F.count_distinct(F.when(F.col("kind") == "claim", F.col("canonical_id"))) / F.count_distinct("canonical_id"), 6).alias("ratio"))


@query("coverage_band_sample", """SELECT story_id FROM (SELECT story_id, count(DISTINCT owner) AS n FROM v_articles WHERE text_source = 'full' GROUP BY story_id) WHERE n BETWEEN 1 AND 5 ORDER BY md5(story_id::VARCHAR) LIMIT 20""")
def _(t: Tables):
    s = t.v_articles.where("text_source = 'full'").groupBy("story_id").agg(F.count_distinct("owner").alias("n")).where("n BETWEEN 1 AND 5")
    return s.orderBy(F.md5(F.col("story_id").cast("string"))).limit(20).select("story_id")


@query("group_confusion_compare", """SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL""")
def _(t: Tables):
    return t.labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_pair_sample", """WITH p AS (SELECT a.article_id AS a, b.article_id AS b, a.lang <> b.lang AS crosses FROM v_articles a JOIN v_articles b ON a.story_id = b.story_id AND a.article_id < b.article_id), r AS (SELECT *, row_number() OVER (PARTITION BY crosses ORDER BY md5(concat(a::VARCHAR, ':', b::VARCHAR))) AS rn FROM p) SELECT a, b, crosses FROM r WHERE rn <= CASE WHEN crosses THEN 20 ELSE 40 END""")
def _(t: Tables):
    x = t.v_articles.select("story_id", F.col("article_id").alias("a"), F.col("lang").alias("la"))
    y = t.v_articles.select("story_id", F.col("article_id").alias("b"), F.col("lang").alias("lb"))
    order = F.md5(F.concat(F.col("a").cast("string"), F.lit(":"), F.col("b").cast("string")))
    p = x.join(y, "story_id").where("a < b").select("a", "b", (F.col("la") != F.col("lb")).alias("crosses"), order.alias("o"))
    # a bounded top by hash in each part of the pairs, merged: no stratum is sorted in one task
    cross, same = (p.where(c).orderBy("o").limit(n) for c, n in (("crosses", 20), ("NOT crosses", 40)))
    return cross.unionByName(same).select("a", "b", "crosses")


@query("latest_by_kind", "SELECT event_type, max(event_id) AS event_id FROM events GROUP BY event_type")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.max("event_id").alias("event_id"))
