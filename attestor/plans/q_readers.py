"""Queries of filters, reader side, enrichment and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.operators import enrichment as E
from attestor.plans.registry import query
from attestor.plans.tables import Tables
from attestor.streaming import jobs as J


@query("readable_filter", "SELECT article_id FROM v_articles WHERE text_source <> 'summary' AND agency IS NULL")
def _(t: Tables):
    return t.v_articles.where("text_source <> 'summary' AND agency IS NULL").select("article_id")


@query("stale_story_filter", "SELECT story_id FROM v_articles GROUP BY story_id HAVING max(published_at) >= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL '36' HOUR")
def _(t: Tables):
    s = t.v_articles.groupBy("story_id").agg(F.max("published_at").alias("m"))
    return s.where(F.col("m") >= F.expr("TIMESTAMP '2024-01-03 00:00:00' - INTERVAL '36' HOUR")).select("story_id")


@query("frozen_filter", "SELECT article_id FROM v_articles WHERE story_id NOT IN (SELECT parent_id FROM v_links WHERE parent_id % 3 = 0)")
def _(t: Tables):
    frozen = t.v_links.where("parent_id % 3 = 0").select(F.col("parent_id").alias("story_id")).distinct()
    return t.v_articles.join(frozen, "story_id", "left_anti").select("article_id")


@query("relevance_predicate", "SELECT story_id, bool_or(government IS NOT NULL) OR count(DISTINCT owner) >= 5 AS relevant FROM v_articles GROUP BY story_id")
def _(t: Tables):
    return t.v_articles.groupBy("story_id").agg((F.bool_or(F.col("government").isNotNull()) | (F.count_distinct("owner") >= 5)).alias("relevant"))


@query("checkable_filter", "SELECT claim_id FROM v_claims WHERE CASE WHEN evidence = 'none' THEN NULL ELSE evidence <> 'unnamed_source' END IS NOT DISTINCT FROM true")
def _(t: Tables):
    c = F.when(F.col("evidence") != "none", F.col("evidence") != "unnamed_source")
    return t.v_claims.where(c.eqNullSafe(True)).select("claim_id")


@query("retry_budget", "SELECT feed_id, count(*) FILTER (ok = 0) < 12 AS allowed FROM v_feed_log GROUP BY feed_id")
def _(t: Tables):
    return t.v_feed_log.groupBy("feed_id").agg((F.count_if(F.col("ok") == 0) < 12).alias("allowed"))


@query("context_keep_vote", "SELECT canonical_id FROM v_claims GROUP BY canonical_id HAVING count(*) FILTER (attributed_to = 'sources') < 2")
def _(t: Tables):
    drop = t.v_claims.groupBy("canonical_id").agg(F.count_if(F.col("attributed_to") == "sources").alias("n"))
    return drop.where("n < 2").select("canonical_id")


@query("self_talk_filter", "SELECT c.claim_id FROM v_claims c JOIN v_outlets o ON c.article_id = o.article_id WHERE NOT (c.attributed_to = 'article' AND o.agency IS NOT NULL)")
def _(t: Tables):
    o = t.v_outlets.select("article_id", "agency")
    return t.v_claims.join(o, "article_id").where(~((F.col("attributed_to") == "article") & F.col("agency").isNotNull())).select("claim_id")


@query("past_schedule_filter", "SELECT claim_id FROM v_claims WHERE NOT (kind = 'event' AND t_start < TIMESTAMP '1995-01-01 00:00:00' AND story_id IN (SELECT story_id FROM v_claims WHERE evidence = 'court_record'))")
def _(t: Tables):
    s = t.v_claims.where("evidence = 'court_record'").select("story_id", F.lit(True).alias("decided")).distinct()
    j = t.v_claims.join(s, "story_id", "left")
    return j.where(~((F.col("kind") == "event") & (F.col("t_start") < F.expr("TIMESTAMP '1995-01-01 00:00:00'")) & F.coalesce("decided", F.lit(False)))).select("claim_id")


@query("stale_vector_stories", "SELECT DISTINCT story_id FROM v_articles a LEFT JOIN embeddings e ON a.article_id = e.vec_id WHERE e.label IS DISTINCT FROM 3 AND a.text_source = 'full'")
def _(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("article_id"), "label")
    return t.v_articles.where("text_source = 'full'").join(e, "article_id", "left").where(~F.col("label").eqNullSafe(F.lit(3))).select("story_id").distinct()


@query("uncovered_statements", "SELECT DISTINCT canonical_id FROM v_claims WHERE (story_id, loaded_word) NOT IN (SELECT story_id, loaded_word FROM v_claims WHERE evidence = 'video')")
def _(t: Tables):
    shown = t.v_claims.where("evidence = 'video'").select("story_id", "loaded_word").distinct()
    return t.v_claims.join(shown, ["story_id", "loaded_word"], "left_anti").select("canonical_id").distinct()


@query("notification_build", "SELECT f.reader, a.article_id, concat(a.outlet, ': ', a.n_chars::VARCHAR) AS body FROM v_follows f JOIN v_articles a ON f.kind = 'story' AND f.follow_key = a.story_id::VARCHAR WHERE a.published_at > TIMESTAMP '2024-01-02 12:00:00' AND (f.reader + a.article_id) % 7 <> 0")
def _(t: Tables):
    a = t.v_articles.where(F.col("published_at") > F.expr("TIMESTAMP '2024-01-02 12:00:00'")).select("article_id", F.col("story_id").cast("string").alias("follow_key"), F.concat("outlet", F.lit(": "), F.col("n_chars").cast("string")).alias("body"))
    return t.v_follows.where("kind = 'story'").join(a, "follow_key").where("(reader + article_id) % 7 <> 0").select("reader", "article_id", "body")


@query("pending_delivery", "SELECT e.event_id, d.kind FROM events e JOIN v_follows d ON e.user_id = d.reader WHERE e.event_type = 'signup' AND e.ts >= (SELECT max(ts) FROM events) - INTERVAL '48' HOUR")
def _(t: Tables):
    last = t.events.agg(F.max("ts").alias("m"))
    e = t.events.where("event_type = 'signup'").join(F.broadcast(last), F.col("ts") >= F.expr("m - INTERVAL '48' HOUR"))
    return e.join(t.v_follows, e["user_id"] == F.col("reader")).select("event_id", "kind")


@query("device_outcome", """SELECT feed_id, CASE WHEN bool_or(kind = 'error' AND log_id % 50 = 0) THEN 'remove' WHEN sum(1 - ok) FILTER (log_id > last_ok) >= 2 THEN 'suspect' ELSE 'keep' END AS outcome FROM (SELECT *, CASE WHEN ok = 0 THEN 'error' ELSE 'ok' END AS kind, coalesce(max(CASE WHEN ok = 1 THEN log_id END) OVER (PARTITION BY feed_id), -1) AS last_ok FROM v_feed_log) GROUP BY feed_id""")
def _(t: Tables):
    last = F.coalesce(F.max(F.when(F.col("ok") == 1, F.col("log_id"))).over(W.partitionBy("feed_id")), F.lit(-1))
    x = t.v_feed_log.withColumn("last_ok", last)
    g = x.groupBy("feed_id").agg(F.bool_or((F.col("ok") == 0) & (F.col("log_id") % 50 == 0)).alias("gone"), F.sum(F.when(F.col("log_id") > F.col("last_ok"), 1 - F.col("ok"))).alias("tail"))
    return g.select("feed_id", F.when(F.col("gone"), "remove").when(F.col("tail") >= 2, "suspect").otherwise("keep").alias("outcome"))


@query("request_dedupe_queue", "SELECT user_id, event_type, min(event_id) AS job FROM events GROUP BY ALL")
def _(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("job"))


@query("daily_request_limit", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, (ts + INTERVAL '330' MINUTE)::DATE ORDER BY ts, event_id) > 1 THEN 'limit' ELSE 'ok' END AS verdict FROM events")
def _(t: Tables):
    w = W.partitionBy("user_id", F.to_date(F.col("ts") + F.expr("INTERVAL '330' MINUTE"))).orderBy("ts", "event_id")
    return t.events.select("event_id", F.when(F.row_number().over(w) > 1, "limit").otherwise("ok").alias("verdict"))


@query("rate_limit_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts::TIMESTAMP) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) <= 2 AS allowed FROM events")
def _(t: Tables):
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3600 * 1_000_000, 0)  # an hour to the microsecond
    return t.events.select("event_id", (F.count(F.lit(1)).over(w) <= 2).alias("allowed"))


@query("artefact_prune", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS keep FROM orders")
def _(t: Tables):
    live = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("k")).distinct()
    return t.orders.select("o_orderkey").join(live, "o_orderkey", "left").select("o_orderkey", F.coalesce("k", F.lit(False)).alias("keep"))


@query("daily_brief", "SELECT published_at::DATE AS day, lang, string_agg(article_id::VARCHAR, ',' ORDER BY article_id) AS articles, min(n_chars) AS weakest FROM v_articles WHERE agency IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("article_id")), lambda x: x.cast("string")), ",")
    return t.v_articles.where("agency IS NOT NULL").groupBy(F.to_date("published_at").alias("day"), "lang").agg(ids.alias("articles"), F.min("n_chars").alias("weakest"))


@query("page_payload", """SELECT story_id, string_agg(concat(canonical_id::VARCHAR, '/', n::VARCHAR, '/', outlets::VARCHAR), ';' ORDER BY canonical_id) AS items, sum(n)::BIGINT AS reports FROM (SELECT story_id, canonical_id, count(*) AS n, count(DISTINCT article_id) AS outlets FROM v_claims GROUP BY ALL) GROUP BY story_id""")
def _(t: Tables):
    n = t.v_claims.groupBy("story_id", "canonical_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("article_id").alias("outlets"))
    item = F.struct("canonical_id", "n", "outlets")
    text = lambda x: F.concat_ws("/", x["canonical_id"].cast("string"), x["n"].cast("string"), x["outlets"].cast("string"))
    return n.groupBy("story_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), text), ";").alias("items"), F.sum("n").alias("reports"))


@query("home_card", """SELECT doc_id, array_to_string(list_filter(string_split(text, '. '), lambda x: length(x) > 20)[1:9], '. ') AS card FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", F.array_join(F.slice(F.filter(F.split("text", r"\. "), lambda x: F.length(x) > 20), 1, 9), ". ").alias("card"))


@query("page_units", "SELECT doc_id, i - 1 AS paragraph, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def _(t: Tables):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).withColumn("paragraph", F.col("paragraph").cast("long"))


def _fake(texts: list[str]) -> list[str]:
    return [f"{len(x)}:{x[:1].lower()}" for x in texts]


@query("enrich_cached", "SELECT claim_id, CASE WHEN loaded_word < 'w12' THEN 'cached' ELSE concat(length(loaded_word)::VARCHAR, ':w') END AS answer FROM v_claims")
def _(t: Tables):
    cache = t.v_claims.where("loaded_word < 'w12'").select(F.sha2("loaded_word", 256).alias("key"), F.lit("cached").alias("answer")).distinct()
    return E.enrich_cached(t.v_claims.select("claim_id", "loaded_word"), "loaded_word", cache, _fake).select("claim_id", "answer")


@query("enrich_twice_swapped", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE length(a.c_mktsegment) <= length(b.c_mktsegment) AND length(b.c_mktsegment) <= length(a.c_mktsegment)")
def _(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("x"))
    b = t.customer.select((F.col("c_custkey") - 1).alias("a"), F.col("c_custkey").alias("b"), F.col("c_mktsegment").alias("y"))
    return E.enrich_twice(a.join(b, "a").select("a", "b", "x", "y"), "x", "y", lambda ps: [len(p) <= len(q) for p, q in ps]).select("a", "b")


@query("enrich_reask_on_growth", "SELECT story_id FROM (SELECT story_id, count(*) AS n, count(*) FILTER (article_id % 3 = 0) AS old FROM v_articles GROUP BY story_id) WHERE old = 0 OR n - old >= 6")
def _(t: Tables):
    now = t.v_articles.groupBy("story_id").agg(F.count(F.lit(1)).alias("n"))
    last = t.v_articles.where("article_id % 3 = 0").groupBy("story_id").agg(F.count(F.lit(1)).alias("n"))
    return E.ask_again(now, last, "story_id", "n", 6)


@query("attribution_resolve", "SELECT claim_id, CASE WHEN attributed_to IN ('sources') THEN 'POOL' WHEN attributed_to IN ('article', 'police', 'PTI') THEN attributed_to WHEN attributed_to < 'person 5' THEN concat('known ', attributed_to) ELSE 'POOL' END AS origin FROM v_claims")
def _(t: Tables):
    known = t.v_claims.where("attributed_to LIKE 'person%' AND attributed_to < 'person 5'").select(F.col("attributed_to").alias("k"), F.concat(F.lit("known "), "attributed_to").alias("a")).distinct()
    rule = F.when(F.col("attributed_to") == "sources", "POOL").when(F.col("attributed_to").isin("article", "police", "PTI"), F.col("attributed_to"))
    return t.v_claims.join(known, F.col("attributed_to") == F.col("k"), "left").select("claim_id", F.coalesce(rule, "a", F.lit("POOL")).alias("origin"))


@query("translate_fill", "SELECT story_id, count(*) FILTER (loaded_word >= 'w12') = 0 AS complete, min(CASE WHEN loaded_word < 'w12' THEN upper(loaded_word) ELSE loaded_word END) AS first_text FROM v_claims GROUP BY story_id")
def _(t: Tables):
    cache = t.v_claims.where("loaded_word < 'w12'").select("loaded_word", F.upper("loaded_word").alias("tr")).distinct()
    j = t.v_claims.join(cache, "loaded_word", "left")
    return j.groupBy("story_id").agg((F.count_if(F.col("tr").isNull()) == 0).alias("complete"), F.min(F.coalesce("tr", "loaded_word")).alias("first_text"))


def _events(t: Tables):
    return J.event_stream(t.spark, f"{t.sf_dir}/events.parquet")


@query("stream_hour_tumbling", "SELECT date_trunc('hour', ts::TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables):
    return J.run_to_table(J.windowed_counts(_events(t), "ts", "1 hour", None, ["event_type"]), "hours", "complete")


@query("stream_window_72h", """SELECT make_timestamp((floor(epoch(ts::TIMESTAMP) / 86400) * 86400 - k * 86400)::BIGINT * 1000000) AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest(range(0, 3)) AS k) GROUP BY ALL""")
def _(t: Tables):
    return J.run_to_table(J.windowed_counts(_events(t), "ts", "72 hours", "24 hours", ["event_type"]), "days", "complete")


@query("stream_ingest_dedup", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY user_id")
def _(t: Tables):
    return J.run_to_table(J.ingest_dedup(_events(t), "event_id", "ts").select("event_id", "user_id"), "fresh").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_settle_session", """WITH g AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '3' HOUR THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '3' HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def _(t: Tables):
    return J.run_to_table(J.settle_sessions(_events(t), "user_id", "ts"), "sessions", "complete")


@query("stream_feed_failures", """WITH i AS (SELECT *, sum(ok) OVER (PARTITION BY feed_id ORDER BY ts, log_id) AS island FROM v_feed_log), r AS (SELECT *, sum(1 - ok) OVER (PARTITION BY feed_id, island ORDER BY ts, log_id) AS run FROM i) SELECT feed_id AS user_id, arg_max(run, (ts, log_id))::BIGINT AS fail_count, max(run)::BIGINT AS longest, max(run) >= 3 AS disabled FROM r GROUP BY feed_id""")
def _(t: Tables):
    s = _events(t).select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("ok"))
    out = J.run_to_table(J.failure_counter(s, "user_id", "ts", "ok", 3), "failures", "update", ["user_id"])
    return out.select("user_id", "fail_count", "longest", "disabled")
