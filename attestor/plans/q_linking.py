"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.functions import relations as R
from attestor.operators import intake as I
from attestor.operators import linking as L
from attestor.plans.q_text import WORDS
from attestor.plans.registry import query
from attestor.plans.tables import Tables

SETS = f"""w AS (SELECT article_id, published_at AS pub, {WORDS.replace('text', "coalesce(text, '')")} AS t FROM v_articles), s0 AS (SELECT article_id, pub, list_sort(CASE WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) END) AS sh FROM w),
s AS (SELECT min(article_id) AS id, sh FROM s0 GROUP BY sh), e AS (SELECT id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS k, any_value(x.n) AS nx, any_value(y.n) AS ny FROM e x JOIN e y ON x.g = y.g AND x.id <> y.id GROUP BY ALL), np AS (SELECT a, b, k::DOUBLE / (nx + ny - k) AS similarity FROM c WHERE k::DOUBLE / (nx + ny - k) >= 0.45),
m0 AS (SELECT article_id, pub, s.id AS set_id FROM s0 JOIN s ON s0.sh = s.sh), m1 AS (SELECT *, coalesce(pub - lag(pub) OVER (PARTITION BY set_id ORDER BY pub, article_id) > INTERVAL '72' HOUR, true) AS begins FROM m0),
m2 AS (SELECT *, sum(begins::INT) OVER (PARTITION BY set_id ORDER BY pub, article_id) AS run FROM m1), m3 AS (SELECT *, first_value(article_id) OVER (PARTITION BY set_id, run ORDER BY pub, article_id) AS chain FROM m2),
ch AS (SELECT set_id, chain, min(pub) AS f, max(pub) AS l, count(*) AS n FROM m3 GROUP BY ALL),
nc AS (SELECT x.chain, y.chain AS other, similarity, x.f, y.f AS of, y.l AS ol FROM np JOIN ch x ON np.a = x.set_id JOIN ch y ON np.b = y.set_id WHERE y.f <= x.l + INTERVAL '72' HOUR AND y.l >= x.f - INTERVAL '72' HOUR)"""


@query("near_dup_join", f"WITH {SETS}, k AS (SELECT chain, count(*) AS n_links FROM nc GROUP BY chain) SELECT article_id, m3.chain AS class_id, ch.n AS copies, coalesce(n_links, 0) AS n_links FROM m3 JOIN ch ON m3.chain = ch.chain LEFT JOIN k ON k.chain = ch.chain")
def _(t: Tables):
    return L.near_dup_classes(t.v_articles)


@query("wire_group_assign", "WITH RECURSIVE " + SETS + """, p AS (SELECT chain, arg_min(other, (-similarity, of, other)) AS parent FROM nc WHERE (of < f OR (of = f AND other < chain)) AND ol >= f - INTERVAL '72' HOUR GROUP BY chain),
r AS (SELECT chain, chain AS root FROM ch WHERE chain NOT IN (SELECT chain FROM p) UNION ALL SELECT p.chain, r.root FROM p JOIN r ON p.parent = r.chain) SELECT article_id, root AS wire_group FROM m3 JOIN r ON m3.chain = r.chain""")
def _(t: Tables):
    return L.wire_groups(t.v_articles)


COS = "list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[])"
TOPK = f"k AS (SELECT q.vec_id, b.vec_id AS other, {COS} AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0)"


@query("vector_topk_join", f"WITH {TOPK} SELECT vec_id, other, round(cosine, 5) AS cosine, rank FROM k WHERE rank <= 40")
def _(t: Tables):
    return L.cosine_topk(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id").withColumn("cosine", F.round("cosine", 5))


@query("story_candidate_score", f"WITH {TOPK}, m AS (SELECT k.vec_id, e.label, cosine, other, row_number() OVER (PARTITION BY k.vec_id, e.label ORDER BY cosine DESC, other) AS r FROM k JOIN embeddings e ON e.vec_id = k.other WHERE rank <= 40) SELECT vec_id, label, round(avg(cosine), 5) AS top2, arg_min(other, r) AS nearest FROM m WHERE r <= 2 GROUP BY ALL")
def _(t: Tables):
    k = L.cosine_topk(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id")
    m = k.join(t.embeddings.select(F.col("vec_id").alias("other"), "label"), "other").withColumn("r", F.row_number().over(W.partitionBy("vec_id", "label").orderBy(F.desc("cosine"), "other")))
    return m.where("r <= 2").groupBy("vec_id", "label").agg(F.round(F.avg("cosine"), 5).alias("top2"), F.min_by("other", "r").alias("nearest"))


@query("nn_percentiles", f"WITH {TOPK}, n AS (SELECT vec_id, max(cosine) AS c FROM k WHERE rank <= 40 GROUP BY vec_id) SELECT round(quantile_cont(c, 0.5), 5) AS p50, round(quantile_cont(c, 0.9), 5) AS p90, count(*) AS n FROM n")
def _(t: Tables):
    n = L.cosine_topk(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id").groupBy("vec_id").agg(F.max("cosine").alias("c"))
    return n.agg(F.round(F.percentile("c", 0.5), 5).alias("p50"), F.round(F.percentile("c", 0.9), 5).alias("p90"), F.count(F.lit(1)).alias("n"))


@query("duplicate_vector_join", """WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 10 = 3 THEN [1.0::FLOAT] ELSE embedding END AS e FROM embeddings) SELECT vec_id FROM v WHERE e IN (SELECT e FROM v GROUP BY e HAVING count(DISTINCT label) > 1)""")
def _(t: Tables):
    v = t.embeddings.select("vec_id", "label", F.md5(F.to_json(F.when(F.col("vec_id") % 10 == 3, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding")))).alias("h"))
    bad = v.groupBy("h").agg(F.count_distinct("label").alias("n")).where("n > 1").select("h")
    return v.join(bad, "h", "left_semi").select("vec_id")


@query("owner_resolve", r"""WITH o AS (SELECT 'src1' AS name, 'Alpha' AS owner, 'example.com' AS domain UNION ALL SELECT 'The Src 2', 'Beta', 'example.org' UNION ALL SELECT 'src9', 'Gamma', 'm.example.com'),
h AS (SELECT page_id, concat('src', (page_id % 12)::VARCHAR) AS outlet, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\.', '') AS host FROM pages),
d AS (SELECT page_id, arg_max(owner, length(domain)) AS owner FROM h JOIN o ON host = domain OR ends_with(host, concat('.', domain)) GROUP BY page_id)
SELECT h.page_id, coalesce(a.owner, b.owner, d.owner, outlet) AS owner FROM h LEFT JOIN o a ON outlet = a.name LEFT JOIN o b ON regexp_replace(lower(outlet), '^the |[^a-z0-9]', '', 'g') = regexp_replace(lower(b.name), '^the |[^a-z0-9]', '', 'g') LEFT JOIN d ON h.page_id = d.page_id""")
def _(t: Tables):
    owners = t.spark.createDataFrame([("src1", "Alpha", "example.com"), ("The Src 2", "Beta", "example.org"), ("src9", "Gamma", "m.example.com")], "name string, owner string, domain string")
    rows = t.pages.select("page_id", F.concat(F.lit("src"), (F.col("page_id") % 12).cast("string")).alias("outlet"), "url")
    return L.owner_resolve(rows, owners, "outlet", I.host_of(F.col("url"))).select("page_id", "owner")


@query("region_of", r"""SELECT page_id, CASE WHEN regexp_matches(h, '\.(in|org)$') THEN 'home' WHEN regexp_matches(h, '\.(com|net)$') AND page_id % 5 = 0 THEN 'home' ELSE 'world' END AS region FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\.', '') AS h FROM pages)""")
def _(t: Tables):
    h = I.host_of(F.col("url"))
    return t.pages.select("page_id", F.when(h.rlike(r"\.(in|org)$"), "home").when(h.rlike(r"\.(com|net)$") & (F.col("page_id") % 5 == 0), "home").otherwise("world").alias("region"))


@query("interval_before_join", "SELECT a.canonical_id, a.claim_id AS a, b.claim_id AS b FROM v_claims a JOIN v_claims b ON a.canonical_id = b.canonical_id AND a.t_end < b.t_start WHERE a.kind = 'event' AND b.kind = 'event'")
def _(t: Tables):
    return L.before_pairs(t.v_claims.where("kind = 'event'"), "canonical_id", "claim_id")


@query("nearest_time_join", """WITH l AS (SELECT log_id, feed_id, ts FROM v_feed_log WHERE ok = 0), r AS (SELECT feed_id, ts AS rt, log_id AS v FROM v_feed_log WHERE ok = 1)
SELECT l.feed_id, l.log_id, arg_min(v, (abs(epoch_us(l.ts) - epoch_us(rt)), rt, v)) AS nearest FROM l JOIN r ON l.feed_id = r.feed_id GROUP BY ALL""")
def _(t: Tables):
    log = t.v_feed_log
    out = L.nearest_in_time(log.where("ok = 0"), log.where("ok = 1").withColumnRenamed("log_id", "nearest"), "feed_id", "log_id", "ts", "nearest")
    return out.where("nearest IS NOT NULL")


@query("update_vs_dispute_join", """WITH s AS (SELECT canonical_id, story_id, min(t_start) AS first_at, max(t_start) AS last_at FROM v_claims WHERE attributed_to = 'police' GROUP BY ALL)
SELECT a.canonical_id AS older, b.canonical_id AS newer FROM s a JOIN s b ON a.story_id = b.story_id AND a.canonical_id <> b.canonical_id AND b.first_at >= a.last_at + INTERVAL '1' HOUR""")
def _(t: Tables):
    s = t.v_claims.where("attributed_to = 'police'").groupBy("canonical_id", "story_id").agg(F.min("t_start").alias("first_at"), F.max("t_start").alias("last_at"))
    a = s.select("story_id", F.col("canonical_id").alias("older"), F.expr("last_at + INTERVAL '1' HOUR").alias("bar"))
    b = s.select("story_id", F.col("canonical_id").alias("newer"), "first_at")
    return a.join(b, "story_id").where("older <> newer AND first_at >= bar").select("older", "newer")


@query("event_before_story", """WITH f AS (SELECT story_id, min(t_start) AS f FROM v_claims WHERE kind = 'claim' GROUP BY story_id) SELECT c.claim_id FROM v_claims c JOIN f ON c.story_id = f.story_id WHERE kind = 'event' AND t_start <= f - INTERVAL '12' HOUR""")
def _(t: Tables):
    c = t.v_claims
    f = c.where("kind = 'claim'").groupBy("story_id").agg(F.min("t_start").alias("f"))
    return c.where("kind = 'event'").join(f, "story_id").where(F.expr("t_start <= f - INTERVAL '12' HOUR")).select("claim_id")


@query("orphan_prune", """SELECT canonical_id FROM (SELECT DISTINCT canonical_id FROM v_claims) WHERE canonical_id NOT IN (SELECT canonical_id FROM v_claims WHERE stance <> 'denies')""")
def _(t: Tables):
    return t.v_claims.select("canonical_id").distinct().join(t.v_claims.where("stance <> 'denies'").select("canonical_id").distinct(), "canonical_id", "left_anti")


@query("relation_endpoint_join", """SELECT DISTINCT a.canonical_id AS src, b.canonical_id AS dst FROM lineitem l JOIN v_claims a ON a.claim_id = l.l_orderkey * 10 + 1 JOIN v_claims b ON b.claim_id = l.l_orderkey * 10 + l.l_linenumber WHERE a.canonical_id <> b.canonical_id""")
def _(t: Tables):
    c = t.v_claims.select("claim_id", "canonical_id")
    rel = t.lineitem.select((F.col("l_orderkey") * 10 + 1).alias("x"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("y"))
    a, b = c.select(F.col("claim_id").alias("x"), F.col("canonical_id").alias("src")), c.select(F.col("claim_id").alias("y"), F.col("canonical_id").alias("dst"))
    return rel.join(a, "x").join(b, "y").where("src <> dst").select("src", "dst").distinct()


@query("semi_anti_membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS big, c_custkey NOT IN (SELECT o_custkey FROM orders) AS idle FROM customer")
def _(t: Tables):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_totalprice") > 300000).alias("big"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("big", F.lit(False)).alias("big"), F.col("big").isNull().alias("idle"))


@query("thread_root", "WITH RECURSIVE p AS (SELECT child_id, min(parent_id) AS parent_id FROM v_links GROUP BY child_id), r AS (SELECT DISTINCT parent_id AS n, parent_id AS root FROM p WHERE parent_id NOT IN (SELECT child_id FROM p) UNION ALL SELECT p.child_id, r.root FROM p JOIN r ON p.parent_id = r.n) SELECT n, root FROM r")
def _(t: Tables):
    return L.story_threads(t.v_links)


@query("search_owner_antijoin", """SELECT story_id, article_id FROM (SELECT a.*, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC, article_id) AS s FROM (SELECT *, row_number() OVER (PARTITION BY story_id, owner ORDER BY published_at DESC, article_id) AS o FROM v_articles WHERE article_id % 2 = 1) a WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM v_articles x WHERE x.article_id % 2 = 0 AND x.story_id = a.story_id AND x.owner = a.owner)) WHERE s <= 3""")
def _(t: Tables):
    a = t.v_articles
    have = a.where("article_id % 2 = 0").select("story_id", "owner").distinct()
    order = [F.col("published_at").desc(), F.col("article_id")]
    found = I.first_by(a.where("article_id % 2 = 1"), ["story_id", "owner"], order).join(have, ["story_id", "owner"], "left_anti")
    return I.cap_per_group(found, ["story_id"], order, 3).select("story_id", "article_id")


@query("parent_fact_background", """WITH f AS (SELECT canonical_id % 1000 AS page, canonical_id, count(*) AS n FROM v_claims GROUP BY canonical_id), r AS (SELECT l.child_id, f.canonical_id, row_number() OVER (PARTITION BY l.child_id ORDER BY n DESC, f.canonical_id) AS rn FROM v_links l JOIN f ON f.page = l.parent_id) SELECT child_id, canonical_id FROM r WHERE rn <= 4""")
def _(t: Tables):
    f = t.v_claims.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n")).withColumn("parent_id", F.col("canonical_id") % 1000)
    return I.cap_per_group(t.v_links.join(f, "parent_id"), ["child_id"], [F.desc("n"), F.col("canonical_id")], 4).select("child_id", "canonical_id")


@query("story_link_upsert", "SELECT child_id, parent_id FROM v_links WHERE child_id % 4 = 0 UNION SELECT child_id, parent_id FROM v_links WHERE child_id % 4 <> 0 AND parent_id % 5 <> 0")
def _(t: Tables):
    have = t.v_links.where("child_id % 4 = 0")
    new = t.v_links.where("parent_id % 5 <> 0").join(have, ["child_id", "parent_id"], "left_anti")
    return have.unionByName(new).distinct()


@query("update_link", "WITH s AS (SELECT canonical_id, lag(canonical_id) OVER (PARTITION BY story_id ORDER BY m, canonical_id) AS older, lead(canonical_id) OVER (PARTITION BY story_id ORDER BY m, canonical_id) AS newer FROM (SELECT story_id, canonical_id, min(t_start) AS m FROM v_claims GROUP BY ALL)) SELECT * FROM s")
def _(t: Tables):
    m = t.v_claims.groupBy("story_id", "canonical_id").agg(F.min("t_start").alias("m"))
    w = W.partitionBy("story_id").orderBy("m", "canonical_id")
    return m.select("canonical_id", F.lag("canonical_id").over(w).alias("older"), F.lead("canonical_id").over(w).alias("newer"))


# Words that tell nothing of a thread.
THREAD_STOP = """the a an of in on at to for from by with and or after over amid as is are was were be has have had its his her their this that new says said police govt government india indian state minister chief
reports report day two three four five protest case court""".split()
_STOP = ", ".join(f"'{w}'" for w in THREAD_STOP)
#: Letters beyond ASCII count as letters where a name ends.
_OTHER_LETTER, _NAME = r"[^\P{L}a-zA-Z]", r"\b(?:[A-Z][a-z]{2,}|[A-Z]{2,})\b"


@query("thread_parent_candidates", rf"""WITH s AS (SELECT article_id, substring(concat(coalesce(title, ''), '. ', coalesce(text, '')), 1, 500) AS s FROM v_articles),
k AS (SELECT article_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z0-9]{{3,}}'), lambda x: x NOT IN ({_STOP})))) AS word FROM s),
n AS (SELECT article_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(s, '{_OTHER_LETTER}', '_', 'g'), '{_NAME}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})))) AS name FROM s),
m AS (SELECT DISTINCT y.article_id AS child, x.article_id AS parent FROM n x JOIN n y ON x.name = y.name AND x.article_id < y.article_id),
c AS (SELECT child, parent, count(*) AS shared FROM m JOIN k x ON x.article_id = parent JOIN k y ON y.article_id = child AND x.word = y.word GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY shared DESC, parent) AS rn FROM c WHERE NOT EXISTS (SELECT 1 FROM v_links l WHERE l.parent_id = c.child AND l.child_id = c.parent)) SELECT child, parent, shared FROM r WHERE rn <= 6""")
def _(t: Tables):
    s = F.substring(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit(""))), 1, 500)
    kept = lambda found: F.array_distinct(F.filter(found, lambda x: ~x.isin(THREAD_STOP)))
    words = kept(F.regexp_extract_all(R.lower(s), F.lit("([a-z0-9]{3,})"), F.lit(1)))
    names = kept(F.transform(F.regexp_extract_all(F.regexp_replace(s, _OTHER_LETTER, "_"), F.lit(R.in_ascii(f"({_NAME})")), F.lit(1)), F.lower))
    links = t.v_links.select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent"))
    return L.parents_by_names(t.v_articles.select("article_id", words.alias("words"), names.alias("names")), "article_id", "words", "names", links)
