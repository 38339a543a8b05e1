"""Queries of scans, sources, sinks and intake windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import intake as I
from attestor.plans.registry import query
from attestor.plans.tables import Tables

NOW = "2024-01-02 00:00:00"


@query("feed_registry_sync", """SELECT coalesce(s.o_custkey, w.c_custkey) AS custkey, CASE WHEN s.o_custkey IS NULL THEN 'insert' WHEN w.c_custkey IS NULL THEN 'disable' ELSE 'keep' END AS action
FROM (SELECT DISTINCT o_custkey FROM orders) s FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) w ON s.o_custkey = w.c_custkey""")
def _(t: Tables):
    return I.sync_registry(t.orders.select(F.col("o_custkey").alias("custkey")), t.customer.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("custkey")), "custkey")


@query("feed_entry_scan", """SELECT article_id, trim(title) AS title, coalesce(CASE WHEN article_id % 4 = 0 THEN NULL ELSE published_at END, published_at + INTERVAL '1' HOUR) AS entry_time
FROM v_articles WHERE length(trim(title)) > 0""")
def _(t: Tables):
    a = t.v_articles.where(F.length(F.trim("title")) > 0)
    return a.select("article_id", F.trim("title").alias("title"), F.coalesce(F.when(F.col("article_id") % 4 != 0, F.col("published_at")), F.expr("published_at + INTERVAL '1' HOUR")).alias("entry_time"))


@query("fresh_url_dedup", """SELECT article_id, title FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY outlet_no, article_id) AS rn FROM v_articles
WHERE published_at >= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL '48' HOUR) WHERE rn = 1""")
def _(t: Tables):
    return I.fresh_entries(t.v_articles, "2024-01-03 00:00:00", 48, "title", order=[F.col("outlet_no"), F.col("article_id")]).select("article_id", "title")


@query("new_link_antijoin", """SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)""")
def _(t: Tables):
    return I.not_stored(t.pages, t.pages.where("page_id % 3 = 0"), "url").select("page_id", "url")


@query("text_fallback", """SELECT article_id, CASE WHEN length(text) >= 400 THEN text ELSE concat_ws(' ', title, outlet) END AS body, CASE WHEN length(text) >= 400 THEN 'full' ELSE 'summary' END AS body_source
FROM v_articles WHERE length(CASE WHEN length(text) >= 400 THEN text ELSE concat_ws(' ', title, outlet) END) >= 60""")
def _(t: Tables):
    return I.fall_back_text(t.v_articles, "text", "title", "outlet").select("article_id", "body", "body_source")


@query("page_main_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", I.tag_strip(F.col("html")).alias("body"))


@query("boilerplate_line_filter", """SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)) AS body FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40) AS l FROM documents)""")
def _(t: Tables):
    return t.documents.select("doc_id", I.line_filter(F.col("text")).alias("body"))


@query("canonical_url", r"""SELECT page_id, concat(lower(regexp_extract(b, '^([a-zA-Z]+://[^/]*)', 1)), regexp_replace(b, '^[a-zA-Z]+://[^/]*', ''), CASE WHEN k <> '' THEN concat('?', k) ELSE '' END) AS url
FROM (SELECT page_id, regexp_replace(p, '\?.*$', '') AS b, array_to_string(list_filter(string_split(regexp_extract(p, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|ref|source)=')), '&') AS k
FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS p FROM pages))""")
def _(t: Tables):
    return t.pages.select("page_id", I.canonical_url(F.col("url")).alias("url"))


@query("registrable_domain", r"""SELECT page_id, CASE WHEN n < 2 THEN h WHEN n >= 3 AND p[n - 1] IN ('co', 'com', 'org', 'net', 'gov', 'ac', 'nic', 'edu') AND length(p[n]) = 2 THEN array_to_string(p[n - 2:n], '.') ELSE array_to_string(p[n - 1:n], '.') END AS domain
FROM (SELECT page_id, h, string_split(h, '.') AS p, len(string_split(h, '.')) AS n FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\.', '') AS h FROM pages))""")
def _(t: Tables):
    return t.pages.select("page_id", I.registrable_domain(I.host_of(F.col("url"))).alias("domain"))


@query("syndicator_filter", r"""SELECT page_id FROM pages WHERE NOT regexp_matches(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\.', ''), '(^|\.)example\.(net|org)$') AND regexp_matches(url, '^https?://')""")
def _(t: Tables):
    return t.pages.where(~I.host_of(F.col("url")).rlike(r"(^|\.)example\.(net|org)$") & F.col("url").rlike("^https?://")).select("page_id")


@query("feed_ingest_counters", """SELECT feed_id, count(*) AS entries, count(*) FILTER (ok = 1) AS added, count(*) FILTER (ok = 0) AS failed, count(*) FILTER (ok = 1) = 0 AS stuck FROM v_feed_log GROUP BY feed_id""")
def _(t: Tables):
    c = I.feed_counters(t.v_feed_log, "feed_id", {"entries": F.lit(True), "added": F.col("ok") == 1, "failed": F.col("ok") == 0})
    return c.withColumn("stuck", F.col("added") == 0)


@query("fair_feed_cap", """SELECT article_id, outlet, rank FROM (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY published_at DESC, article_id) AS rank FROM v_articles) WHERE rank <= 30 ORDER BY published_at DESC, article_id LIMIT 400""")
def _(t: Tables):
    order = [F.col("published_at").desc(), F.col("article_id")]
    return I.fair_cap(t.v_articles, "outlet", order, 30, 400).select("article_id", "outlet", "rank")


@query("consecutive_failures", """SELECT log_id, feed_id, sum(1 - ok) OVER (PARTITION BY feed_id, island ORDER BY ts, log_id)::BIGINT AS fail_count, sum(1 - ok) OVER (PARTITION BY feed_id, island ORDER BY ts, log_id) >= 3 AS disabled
FROM (SELECT *, sum(ok) OVER (PARTITION BY feed_id ORDER BY ts, log_id) AS island FROM v_feed_log)""")
def _(t: Tables):
    return I.failure_runs(t.v_feed_log, "feed_id", ["ts", "log_id"], "ok", 3).select("log_id", "feed_id", F.col("fail_count").cast("long").alias("fail_count"), "disabled")


@query("snapshot_diff_sync", """SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.f IS NULL THEN 'added' WHEN b.f IS NULL THEN 'deleted' WHEN a.f = b.f THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT o_orderkey AS k, md5(concat_ws('|', coalesce(o_custkey::VARCHAR, ''), coalesce(o_orderstatus, ''))) AS f FROM orders WHERE o_orderkey % 7 <> 0) a
FULL JOIN (SELECT o_orderkey AS k, md5(concat_ws('|', coalesce((CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END)::VARCHAR, ''), coalesce(o_orderstatus, ''))) AS f FROM orders WHERE o_orderkey % 11 <> 0) b ON a.k = b.k""")
def _(t: Tables):
    old = t.orders.where("o_orderkey % 7 <> 0")
    new = t.orders.where("o_orderkey % 11 <> 0").withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END"))
    return I.snapshot_diff(old, new, "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("changed_value_fetch", """SELECT d.doc_id, c.doc_id IS NOT NULL AS hit FROM (SELECT doc_id, md5(text) AS h FROM documents) d LEFT JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 9 = 0 THEN concat(text, '.') ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0) c ON d.doc_id = c.doc_id AND d.h = c.h""")
def _(t: Tables):
    now = t.documents.select("doc_id", F.md5("text").alias("h"))
    cache = t.documents.where("doc_id % 4 <> 0").select("doc_id", F.md5(F.expr("CASE WHEN doc_id % 9 = 0 THEN concat(text, '.') ELSE text END")).alias("h"), F.lit(True).alias("hit"))
    return now.join(cache, ["doc_id", "h"], "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("incremental_export", """SELECT n.article_id, CASE WHEN o.article_id IS NULL THEN 'write' WHEN o.s <> n.s THEN 'rewrite' ELSE 'skip' END AS action FROM (SELECT article_id, md5(concat_ws('|', title, text)) AS s FROM v_articles) n
LEFT JOIN (SELECT article_id, md5(concat_ws('|', title, CASE WHEN article_id % 6 = 0 THEN lower(text) ELSE text END)) AS s FROM v_articles WHERE article_id % 5 <> 0) o ON n.article_id = o.article_id""")
def _(t: Tables):
    a = t.v_articles
    new = a.select("article_id", F.md5(F.concat_ws("|", "title", "text")).alias("s"))
    old = a.where("article_id % 5 <> 0").select(F.col("article_id").alias("i"), F.md5(F.concat_ws("|", "title", F.expr("CASE WHEN article_id % 6 = 0 THEN lower(text) ELSE text END"))).alias("o"))
    return new.join(old, F.col("article_id") == F.col("i"), "left").select("article_id", F.when(F.col("i").isNull(), "write").when(F.col("o") != F.col("s"), "rewrite").otherwise("skip").alias("action"))


@query("page_archive_append", """SELECT article_id, strftime(published_at, '%Y-%m') AS month FROM v_articles WHERE published_at < TIMESTAMP '2024-01-02 00:00:00' - INTERVAL '12' HOUR AND article_id % 4 <> 0""")
def _(t: Tables):
    due = t.v_articles.where(F.col("published_at") < F.expr("TIMESTAMP '2024-01-02 00:00:00' - INTERVAL '12' HOUR"))
    listed = t.v_articles.where("article_id % 4 = 0")
    return I.not_stored(due, listed, "article_id").select("article_id", F.date_format("published_at", "yyyy-MM").alias("month"))


@query("tagged_union", """SELECT 'article' AS type, article_id AS id FROM v_articles UNION ALL SELECT 'claim', claim_id FROM v_claims UNION ALL SELECT 'link', child_id FROM v_links""")
def _(t: Tables):
    part = lambda k, d, c: d.select(F.lit(k).alias("type"), F.col(c).cast("long").alias("id"))
    return part("article", t.v_articles, "article_id").unionByName(part("claim", t.v_claims, "claim_id")).unionByName(part("link", t.v_links, "child_id"))


@query("retention_clear", """SELECT article_id, CASE WHEN age <= 4 * 0.5 THEN author END AS author, CASE WHEN age <= 14 * 0.5 THEN n_chars END AS n_chars FROM (SELECT *, (epoch(TIMESTAMP '2024-01-10 00:00:00') - epoch(published_at)) / 86400.0 AS age FROM v_articles) WHERE story_id % 10 = 0 OR age <= 16 * 0.5""")
def _(t: Tables):
    out = I.clear_by_age(t.v_articles, "published_at", "2024-01-10 00:00:00", {"author": 4, "n_chars": 14}, 16, F.col("story_id") % 10 == 0, 0.5)
    return out.select("article_id", "author", "n_chars")


@query("backfill_missing", """SELECT article_id FROM v_articles WHERE agency IS NULL ORDER BY published_at DESC, article_id LIMIT 100""")
def _(t: Tables):
    return I.newest_missing(t.v_articles, "agency", [F.col("published_at").desc(), F.col("article_id")], 100).select("article_id")


@query("cascade_delete", """SELECT 'lineitem' AS child, count(*) AS left_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus <> 'F'""")
def _(t: Tables):
    kept = I.without_doomed({"lineitem": (t.lineitem, "l_orderkey"), "orders": (t.orders, "o_orderkey")}, t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey")
    parts = [df.agg(F.count(F.lit(1)).alias("left_rows")).select(F.lit(n).alias("child"), "left_rows") for n, df in kept.items()]
    return parts[0].unionByName(parts[1])


@query("quota_ledger", """SELECT feed_id, day, requests, used, sum(used) OVER (PARTITION BY feed_id, date_trunc('month', day) ORDER BY day)::BIGINT AS month_used FROM (SELECT feed_id, ts::DATE AS day, count(*) AS requests, sum(ok)::BIGINT AS used FROM v_feed_log GROUP BY ALL)""")
def _(t: Tables):
    return I.ledger_rollup(t.v_feed_log, "feed_id", "ts", "ok").select("feed_id", "day", "requests", F.col("used").cast("long").alias("used"), F.col("month_used").cast("long").alias("month_used"))


@query("subset_copy", """SELECT claim_id, story_id, kind FROM v_claims WHERE story_id IN (SELECT story_id FROM v_articles WHERE outlet = 'src1')""")
def _(t: Tables):
    return t.v_claims.join(t.v_articles.where("outlet = 'src1'").select("story_id").distinct(), "story_id", "left_semi").select("claim_id", "story_id", "kind")


@query("page_share_image", r"""SELECT page_id, nullif(coalesce(nullif(regexp_extract(html, '<meta[^>]*property="og:image"[^>]*content="(https?://[^"]{1,1000})"', 1), ''), nullif(regexp_extract(html, '<img[^>]*src="(https?://[^"]{1,1000})"', 1), '')), '') AS image FROM pages""")
def _(t: Tables):
    pick = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return t.pages.select("page_id", F.coalesce(pick(r'<meta[^>]*property="og:image"[^>]*content="(https?://[^"]{1,1000})"'), pick(r'<img[^>]*src="(https?://[^"]{1,1000})"')).alias("image"))


@query("round_robin_pick", """WITH r AS (SELECT article_id, story_id, row_number() OVER (PARTITION BY story_id ORDER BY published_at, article_id) AS rnd FROM v_articles) SELECT article_id, rnd FROM r WHERE rnd <= 3 ORDER BY rnd, story_id LIMIT 200""")
def _(t: Tables):
    r = I.cap_per_group(t.v_articles, ["story_id"], [F.col("published_at"), F.col("article_id")], 3)
    return r.orderBy("rank", "story_id").limit(200).select("article_id", F.col("rank").alias("rnd"))


@query("per_source_pick", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY story_id, owner ORDER BY published_at DESC, n_chars DESC, article_id) AS g FROM v_articles WHERE text_source = 'full'), p AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC, article_id) AS s, count(*) OVER (PARTITION BY story_id) AS n FROM o WHERE g = 1)
SELECT story_id, article_id, owner FROM p WHERE s <= 8 AND n >= 3""")
def _(t: Tables):
    from pyspark.sql import Window as W

    one = I.first_by(t.v_articles.where("text_source = 'full'"), ["story_id", "owner"], [F.col("published_at").desc(), F.col("n_chars").desc(), F.col("article_id")])
    n = one.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("story_id"))).where("n >= 3")
    return I.cap_per_group(n, ["story_id"], [F.col("published_at").desc(), F.col("article_id")], 8).select("story_id", "article_id", "owner")


@query("latest_two_per_outlet", """SELECT outlet, article_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY published_at DESC, article_id) AS rank FROM v_articles WHERE text_source = 'summary') WHERE rank <= 2""")
def _(t: Tables):
    return I.cap_per_group(t.v_articles.where("text_source = 'summary'"), ["outlet"], [F.col("published_at").desc(), F.col("article_id")], 2).select("outlet", "article_id", "rank")


@query("per_channel_cap", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n_chars DESC, article_id) AS rank FROM v_articles) SELECT article_id, author FROM c WHERE rank <= 2 ORDER BY n_chars DESC, article_id LIMIT 10""")
def _(t: Tables):
    order = [F.col("n_chars").desc(), F.col("article_id")]
    return I.fair_cap(t.v_articles, "author", order, 2, 10).select("article_id", "author")


@query("blocked_page_pick", """WITH f AS (SELECT story_id, count(DISTINCT owner) AS readable FROM v_articles WHERE text_source = 'full' GROUP BY story_id), b AS (SELECT a.story_id, a.owner, a.article_id, row_number() OVER (PARTITION BY a.story_id, a.owner ORDER BY a.article_id) AS rn FROM v_articles a
WHERE text_source = 'summary' AND NOT EXISTS (SELECT 1 FROM v_articles x WHERE x.story_id = a.story_id AND x.owner = a.owner AND x.text_source = 'full')) SELECT b.story_id, b.owner, b.article_id FROM b LEFT JOIN f ON b.story_id = f.story_id WHERE rn = 1 ORDER BY coalesce(readable, 0) DESC, b.article_id LIMIT 50""")
def _(t: Tables):
    a = t.v_articles
    full = a.where("text_source = 'full'")
    readable = full.groupBy("story_id").agg(F.count_distinct("owner").alias("readable"))
    blocked = a.where("text_source = 'summary'").join(full.select("story_id", "owner").distinct(), ["story_id", "owner"], "left_anti")
    one = I.first_by(blocked, ["story_id", "owner"], [F.col("article_id")]).join(readable, "story_id", "left")
    return one.orderBy(F.coalesce("readable", F.lit(0)).desc(), "article_id").limit(50).select("story_id", "owner", "article_id")
