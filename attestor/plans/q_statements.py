"""Queries of statement functions, gates, pages and the remaining joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import figures as G
from attestor.functions import relations as R
from attestor.functions import statements as X
from attestor.functions.text import words
from attestor.operators import intake as I
from attestor.operators import linking as L
from attestor.operators import names as N
from attestor.operators.graph import connected_components
from attestor.plans.q_text import WORDS
from attestor.plans.registry import query
from attestor.plans.tables import Tables
from attestor.streaming import jobs as J


@query("daily_tagged_archive", """SELECT published_at::DATE AS day, 'article' AS type, count(*) AS records FROM v_articles GROUP BY ALL UNION ALL SELECT ts::DATE, 'log', count(*) FROM v_feed_log GROUP BY ALL""")
def _(t: Tables):
    a = t.v_articles.select(F.to_date("published_at").alias("day"), F.struct("article_id", "title", "outlet").alias("x"))
    b = t.v_feed_log.select(F.to_date("ts").alias("day"), F.struct("log_id", "ok").alias("x"))
    both = a.select("day", F.lit("article").alias("type"), F.to_json("x").alias("record")).unionByName(b.select("day", F.lit("log").alias("type"), F.to_json("x").alias("record")))
    return both.groupBy("day", "type").agg(F.count("record").alias("records"))


@query("outlet_canonicalise", r"""WITH k AS (SELECT s_suppkey, regexp_replace(lower(s_name), '^the |[^a-z0-9]', '', 'g') AS key, s_name FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('The ', s_name) WHEN s_suppkey % 3 = 1 THEN upper(s_name) ELSE s_name END AS s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier)) SELECT s_suppkey, s_name, min(s_name) OVER (PARTITION BY key) AS canonical FROM k""")
def _(t: Tables):
    s = t.supplier.select("s_suppkey", "s_name")
    odd = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("The "), "s_name")).when(F.col("s_suppkey") % 3 == 1, F.upper("s_name")).otherwise(F.col("s_name")).alias("s_name"))
    k = odd.unionByName(s).withColumn("key", F.regexp_replace(F.lower("s_name"), "^the |[^a-z0-9]", ""))
    first = k.groupBy("key").agg(F.min("s_name").alias("canonical"))
    return k.join(first, "key").select("s_suppkey", "s_name", "canonical")


@query("state_government", "SELECT article_id, coalesce(government, CASE WHEN agency = 'PTI' THEN 'union' END) AS voice FROM v_outlets")
def _(t: Tables):
    return t.v_outlets.select("article_id", F.coalesce("government", F.when(F.col("agency") == "PTI", "union")).alias("voice"))


NAMES = r"regexp_extract_all(title, '[^.!?\s]\s+(\p{Lu}\p{L}{2,})', 1)"


@query("headline_names", f"SELECT article_id, array_to_string(list_sort(list_distinct({NAMES})), ',') AS names FROM v_articles")
def _(t: Tables):
    return t.v_articles.select("article_id", F.array_join(F.array_sort(X.capital_names(F.col("title"))), ",").alias("names"))


_LATIN = "translate(replace(lower(v), 'ph', 'f'), 'wzq', 'vjk')"
_LETTERS = rf"""CASE WHEN regexp_matches(v, '[\x{{0900}}-\x{{097f}}]') THEN string_split(regexp_replace(translate(v, '{"".join(N.DEVANAGARI)}', '{"".join(N.DEVANAGARI.values())}'), '[^a-z]', '', 'g'), '')
  ELSE string_split(regexp_replace(replace({_LATIN}, 'x', 'ks'), '[^a-z]|[aeiouhy]', '', 'g'), '') END"""
_TOKENS = "'" + N.HEADLINE_WORD.replace("'", "''") + "'"
_BARE = "regexp_replace(regexp_replace(w, '{}', ''), '{}', '')".format(*(p.replace("'", "''") for p in N.POSSESSIVE))
_NEAR = "abs(epoch_us({a}.pub) - epoch_us({b}.pub)) <= 172800000000"


@query("region_gate_hold", rf"""WITH g AS (SELECT article_id, owner, published_at AS pub, lang = 'en' AS home, coalesce(title, '') AS title, concat(coalesce(title, ''), '. ', substring(coalesce(text, ''), 1, 300)) AS body FROM v_articles),
tk AS (SELECT article_id, owner, pub, home, unnest(regexp_extract_all(CASE WHEN home THEN title ELSE body END, {_TOKENS})) AS w FROM g), br AS (SELECT *, {_BARE} AS v FROM tk),
nm AS (SELECT *, {_LETTERS} AS k FROM br WHERE regexp_matches(v, '^[\x{{0900}}-\x{{097f}}]') OR (regexp_matches(v, '^[A-Z]') AND length(v) >= 3 AND lower(v) NOT IN ({", ".join(f"'{w}'" for w in N.NOT_NAMES)}))),
sk AS (SELECT DISTINCT article_id, owner, pub, home, array_to_string(list_filter(k, lambda x, i: i = 1 OR x <> k[i - 1]), '') AS name FROM nm), t AS (SELECT * FROM sk WHERE length(name) >= 3),
b AS (SELECT x.article_id FROM t x JOIN t y ON x.name = y.name AND NOT x.home AND y.home AND {_NEAR.format(a='x', b='y')} GROUP BY x.article_id, y.article_id HAVING count(*) >= 2),
o AS (SELECT x.article_id, y.owner FROM t x JOIN t y ON x.name = y.name AND NOT x.home AND NOT y.home AND x.owner <> y.owner AND {_NEAR.format(a='x', b='y')} GROUP BY x.article_id, y.article_id, y.owner HAVING count(*) >= 2),
c AS (SELECT article_id FROM o GROUP BY article_id HAVING count(DISTINCT owner) >= 2)
SELECT article_id FROM g WHERE NOT home AND NOT regexp_matches(body, '{N.HOME_TERMS}') AND article_id NOT IN (SELECT article_id FROM b) AND article_id NOT IN (SELECT article_id FROM c)""")
def _(t: Tables):
    body = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce("text", F.lit("")), 1, 300))
    a = t.v_articles.select("article_id", "owner", "published_at", (F.col("lang") == "en").alias("home"), F.coalesce("title", F.lit("")).alias("title"), body.alias("body"))
    a = a.select("article_id", "owner", "published_at", "home", N.headline_skeletons(F.when(F.col("home"), F.col("title")).otherwise(F.col("body"))).alias("names"), F.col("body").rlike(R.in_ascii(N.HOME_TERMS)).alias("told"))
    return L.held_at_gate(a, "article_id", "home", "owner", "published_at", "names", "told")


@query("statement_pair_join", """SELECT a.canonical_id AS a, b.canonical_id AS b, CASE WHEN a.w = b.w AND a.e = b.e THEN 'same' WHEN a.w = b.w THEN 'ask' ELSE 'different' END AS relation FROM (SELECT story_id, canonical_id, min(loaded_word) AS w, min(evidence) AS e FROM v_claims GROUP BY ALL) a JOIN (SELECT story_id, canonical_id, min(loaded_word) AS w, min(evidence) AS e FROM v_claims GROUP BY ALL) b ON a.story_id = b.story_id AND a.canonical_id < b.canonical_id""")
def _(t: Tables):
    p = t.v_claims.groupBy("story_id", "canonical_id").agg(F.min("loaded_word").alias("w"), F.min("evidence").alias("e"))
    a, b = p.select("story_id", F.col("canonical_id").alias("a"), "w", "e"), p.select("story_id", F.col("canonical_id").alias("b"), F.col("w").alias("w2"), F.col("e").alias("e2"))
    same = F.when((F.col("w") == F.col("w2")) & (F.col("e") == F.col("e2")), "same").when(F.col("w") == F.col("w2"), "ask").otherwise("different")
    return a.join(b, "story_id").where("a < b").select("a", "b", same.alias("relation"))


@query("apply_name_map", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\bThe\b', 'Teh', 'g'), '\band\b', 'und', 'g')) AS digest FROM documents")
def _(t: Tables):
    out = F.col("text")
    for old, new in (("The", "Teh"), ("and", "und")):
        out = F.regexp_replace(out, rf"\b{old}\b", new)
    return t.documents.select("doc_id", F.md5(out).alias("digest"))


@query("speaker_key", "SELECT claim_id, CASE WHEN attributed_to = 'police' THEN 'gov:police' WHEN regexp_matches(attributed_to, '^[a-z]+ [0-9]+$') THEN regexp_extract(attributed_to, '([0-9]+)$', 1) ELSE lower(attributed_to) END AS speaker FROM v_claims")
def _(t: Tables):
    a = F.col("attributed_to")
    return t.v_claims.select("claim_id", F.when(a == "police", "gov:police").when(a.rlike("^[a-z]+ [0-9]+$"), F.regexp_extract(a, "([0-9]+)$", 1)).otherwise(F.lower(a)).alias("speaker"))


@query("frame_entities", """SELECT story_id, string_agg(w, ',' ORDER BY f, w) AS entities FROM (SELECT story_id, w, f, row_number() OVER (PARTITION BY story_id ORDER BY f, w) AS rn FROM (SELECT story_id, lower(loaded_word) AS w, min(claim_id) AS f FROM v_claims WHERE kind = 'event' AND length(loaded_word) > 2 GROUP BY ALL)) WHERE rn <= 4 GROUP BY story_id""")
def _(t: Tables):
    f = t.v_claims.where("kind = 'event' AND length(loaded_word) > 2").groupBy("story_id", F.lower("loaded_word").alias("w")).agg(F.min("claim_id").alias("f"))
    four = I.cap_per_group(f, ["story_id"], [F.col("f"), F.col("w")], 4)
    return four.groupBy("story_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda x: x["w"]), ",").alias("entities"))


@query("section_paths", """SELECT article_id, unnest([concat('s', (outlet_no % 5)::VARCHAR), concat('s', (outlet_no % 5)::VARCHAR, '/', outlet_no::VARCHAR), concat('s', (outlet_no % 5)::VARCHAR, '/', outlet_no::VARCHAR, '/', lang)]) AS path FROM v_articles""")
def _(t: Tables):
    top = F.concat(F.lit("s"), (F.col("outlet_no") % 5).cast("string"))
    mid = F.concat(top, F.lit("/"), F.col("outlet_no").cast("string"))
    return t.v_articles.select("article_id", F.explode(F.array(top, mid, F.concat(mid, F.lit("/"), "lang"))).alias("path"))


@query("place_confirm", f"""WITH p(place, word) AS (VALUES ('north', 'the'), ('south', 'queen'), ('east', 'den'), ('west', 'of'), ('mid', 'los')), r AS (SELECT doc_id, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS rn FROM (SELECT DISTINCT doc_id, place FROM (SELECT doc_id, unnest({WORDS}) AS word FROM documents) d JOIN p USING (word))) SELECT doc_id, place FROM r WHERE rn <= 3""")
def _(t: Tables):
    p = t.spark.createDataFrame([("north", "the"), ("south", "queen"), ("east", "den"), ("west", "of"), ("mid", "los")], "place string, word string")
    hit = t.documents.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(F.broadcast(p), "word").select("doc_id", "place").distinct()
    return I.cap_per_group(hit, ["doc_id"], [F.col("place")], 3).select("doc_id", "place")


COLOUR = "CASE WHEN v IN ('disputed', 'unverified') THEN v WHEN g <= 1 AND f > 0 THEN 'partial' WHEN g <= 1 THEN 'single' ELSE v END"
VERDICT = "SELECT story_id, canonical_id, CASE WHEN count(*) FILTER (stance = 'denies') > 1 THEN 'disputed' WHEN count(*) > 3 THEN 'corroborated' WHEN count(*) > 1 THEN 'developing' ELSE 'unverified' END AS v, count(DISTINCT article_id) AS g, count(*) FILTER (kind = 'event') AS f FROM v_claims GROUP BY ALL"


def _coloured(t: Tables):
    d = F.count_if(F.col("stance") == "denies")
    n = F.count(F.lit(1))
    c = t.v_claims.groupBy("story_id", "canonical_id").agg(F.when(d > 1, "disputed").when(n > 3, "corroborated").when(n > 1, "developing").otherwise("unverified").alias("v"), F.count_distinct("article_id").alias("g"), F.count_if(F.col("kind") == "event").alias("f"))
    return c.withColumn("colour", X.colour(F.col("v"), F.col("g"), F.col("f")))


@query("statement_colour", f"SELECT canonical_id, {COLOUR} AS colour FROM ({VERDICT})")
def _(t: Tables):
    return _coloured(t).select("canonical_id", "colour")


@query("section_assign", f"SELECT canonical_id, CASE WHEN f > 0 AND c IN ('corroborated', 'developing') THEN 'news' WHEN f > 0 THEN 'happened' WHEN c = 'disputed' THEN 'say' ELSE 'background' END AS section FROM (SELECT canonical_id, f, {COLOUR} AS c FROM ({VERDICT}))")
def _(t: Tables):
    s = F.when((F.col("f") > 0) & F.col("colour").isin("corroborated", "developing"), "news").when(F.col("f") > 0, "happened").when(F.col("colour") == "disputed", "say").otherwise("background")
    return _coloured(t).select("canonical_id", s.alias("section"))


@query("publish_gate", f"""SELECT story_id, CASE WHEN story_id IN (SELECT parent_id FROM v_links) THEN 'published' WHEN n < 20 THEN 'few statements' WHEN weak * 2 > n THEN 'weak' ELSE 'publish' END AS gate FROM (SELECT story_id, count(*) AS n, count(*) FILTER ({COLOUR} IN ('disputed', 'unverified')) AS weak FROM ({VERDICT}) GROUP BY story_id)""")
def _(t: Tables):
    s = _coloured(t).groupBy("story_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("colour").isin("disputed", "unverified")).alias("weak"))
    done = t.v_links.select(F.col("parent_id").alias("story_id"), F.lit(True).alias("done")).distinct()
    gate = F.when(F.col("done"), "published").when(F.col("n") < 20, "few statements").when(F.col("weak") * 2 > F.col("n"), "weak").otherwise("publish")
    return s.join(done, "story_id", "left").select("story_id", gate.alias("gate"))


#: Phrases put behind the documents, which hold few figures, with the values in them.
FIGURES = {"twenty-six people": [26], "two lakh fifty thousand voters": [250000], "Rs 1.5 lakh crore": [1.5e12], "Section IV": [4], "\u0968\u096c dead": [26], "the twenty-sixth": [], "a dozen and two hundred and five": [12, 205], "25 basis points": [0.25]}
_SCALES = G.SCALES | G.AFTER_DIGITS


@query("figures_extract", rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\d+(?:[.,]\d+)*(?:(?:st|nd|rd|th)\b|\s*(?:basis\s+points?|bps)\b|(?:\s*(?:{"|".join(sorted(_SCALES, key=len, reverse=True))})\b)+)?')) AS x, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '\d+(?:[.,]\d+)*(?:(?:st|nd|rd|th)\b|\s*(?:basis\s+points?|bps)\b|(?:\s*(?:{"|".join(sorted(_SCALES, key=len, reverse=True))})\b)+)?'), 1) AS i FROM documents),
v AS (SELECT doc_id, i, TRY_CAST(replace(regexp_extract(x, '^[\d.,]+'), ',', '') AS DOUBLE) * CASE WHEN regexp_matches(x, '(points?|bps)$') THEN 0.01 ELSE coalesce(list_product(list_transform(regexp_extract_all(x, '[a-z]+'), lambda w: CASE {" ".join(f"WHEN w = '{w}' THEN {v}" for w, v in _SCALES.items())} ELSE 1.0 END)), 1.0) END AS v FROM m),
l AS (SELECT doc_id, list(v ORDER BY i) AS vs FROM v WHERE v IS NOT NULL GROUP BY doc_id), p AS (SELECT doc_id, CASE doc_id % {len(FIGURES)} {" ".join(f"WHEN {i} THEN {list(map(float, v))}::DOUBLE[]" for i, v in enumerate(FIGURES.values()))} END AS planted FROM documents)
SELECT p.doc_id, array_to_string(list_transform(list_concat(coalesce(vs, []), planted), lambda v: floor((v * 100) % 1000003)::BIGINT::VARCHAR), ',') AS figures FROM p LEFT JOIN l ON p.doc_id = l.doc_id""")
def _(t: Tables):
    phrase = F.element_at(F.array(*[F.lit(p) for p in FIGURES]), (F.col("doc_id") % len(FIGURES) + 1).cast("int"))
    found = G.values_of(F.concat_ws(" . ", "text", phrase))
    return t.documents.select("doc_id", F.array_join(F.transform(found, lambda v: F.floor((v * 100) % 1000003).cast("bigint").cast("string")), ",").alias("figures"))


@query("frame_compare", """SELECT a.l_orderkey, CASE WHEN a.l_partkey % 5 <> b.l_partkey % 5 THEN 'different' WHEN abs(a.l_quantity - b.l_quantity)::DOUBLE <= CASE WHEN a.l_tax > 0.04 THEN 0.05 ELSE 0.005 END::DOUBLE * greatest(abs(a.l_quantity), abs(b.l_quantity))::DOUBLE THEN 'same' ELSE 'conflict' END AS relation FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2""")
def _(t: Tables):
    a = t.lineitem.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("p"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_tax") > 0.04).alias("approx"))
    b = t.lineitem.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("q"), F.col("l_quantity").cast("double").alias("y"))
    r = F.when(F.col("p") % 5 != F.col("q") % 5, "different").when(X.values_agree(F.col("x"), F.col("y"), F.col("approx")), "same").otherwise("conflict")
    return a.join(b, "l_orderkey").select("l_orderkey", r.alias("relation"))


@query("iso_time_parse", """SELECT event_id, strftime(try_cast(x AS TIMESTAMP), '%Y-%m-%d %H:%M') AS at FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts::TIMESTAMP, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts::TIMESTAMP, '%Y-%m-%d') ELSE 'soon' END AS x FROM events)""")
def _(t: Tables):
    e, ts = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    x = F.when(e == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(e == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(e == 2, F.date_format(ts, "yyyy-MM-dd")).otherwise("soon")
    return t.events.select("event_id", X.iso_minutes(x).alias("at"))


@query("when_words", "SELECT claim_id, CASE WHEN regexp_matches(loaded_word, '^w1') THEN concat('on ', strftime(t_start, '%d %B')) ELSE loaded_word END AS when_text FROM v_claims")
def _(t: Tables):
    return t.v_claims.select("claim_id", F.when(F.col("loaded_word").rlike("^w1"), F.concat(F.lit("on "), F.date_format("t_start", "dd MMMM"))).otherwise(F.col("loaded_word")).alias("when_text"))


@query("map_build_lookup", "SELECT c.claim_id, min(c.attributed_to) OVER (PARTITION BY c.story_id, c.article_id) AS grp FROM v_claims c")
def _(t: Tables):
    g = t.v_claims.groupBy("story_id", "article_id").agg(F.min("attributed_to").alias("grp"))
    return t.v_claims.select("claim_id", "story_id", "article_id").join(g, ["story_id", "article_id"]).select("claim_id", "grp")


@query("json_path_extract", "SELECT article_id, title AS headline, n_chars > 100 AS has_body FROM v_articles")
def _(t: Tables):
    j = t.v_articles.select("article_id", F.to_json(F.struct(F.col("title").alias("headline"), F.struct(F.when(F.col("n_chars") > 100, F.col("lang")).alias("lang")).alias("body"))).alias("j"))
    return j.select("article_id", F.get_json_object("j", "$.headline").alias("headline"), F.get_json_object("j", "$.body.lang").isNotNull().alias("has_body"))


@query("page_slim", "SELECT story_id, string_agg(concat(canonical_id::VARCHAR, '=', v), ';' ORDER BY canonical_id) AS items FROM (" + VERDICT + ") GROUP BY story_id")
def _(t: Tables):
    full = _coloured(t).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("canonical_id", "v", "g", "f"))).alias("items"))
    return full.select("story_id", F.array_join(F.transform("items", lambda x: F.concat(x["canonical_id"].cast("string"), F.lit("="), x["v"])), ";").alias("items"))


@query("adds_detail", """SELECT a.doc_id, b.doc_id AS other, len(list_filter(list_distinct(a.w), lambda x: NOT list_contains(b.w, x) AND length(x) >= 8)) > 3 AS adds FROM (SELECT doc_id, """ + WORDS + """ AS w FROM documents) a JOIN (SELECT doc_id, """ + WORDS + """ AS w FROM documents) b ON b.doc_id // 8 = a.doc_id // 8 AND a.doc_id <> b.doc_id""")
def _(t: Tables):
    w = t.documents.select("doc_id", F.expr("doc_id div 8").alias("story"), words(F.col("text")).alias("w"))
    b = w.select("story", F.col("doc_id").alias("other"), F.col("w").alias("v"))
    return w.join(b, "story").where("doc_id <> other").select("doc_id", "other", (F.size(F.filter(F.array_except("w", "v"), lambda x: F.length(x) >= 8)) > 3).alias("adds"))


@query("video_relevance", """WITH k AS (SELECT article_id, outlet, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda x: length(x) >= 7), lambda x: left(x, 5)))) AS r FROM v_articles) SELECT a.article_id AS video, b.article_id AS page, count(*) AS shared FROM k a JOIN k b ON a.r = b.r AND a.outlet = 'src1' AND b.outlet = 'src2' GROUP BY ALL HAVING count(*) >= 2""")
def _(t: Tables):
    roots = F.array_distinct(F.transform(F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) >= 7), lambda x: F.left(x, F.lit(5))))
    k = t.v_articles.select("article_id", "outlet", roots.alias("terms"))
    return L.shared_terms(k.where("outlet = 'src1'").withColumnRenamed("article_id", "video"), k.where("outlet = 'src2'").withColumnRenamed("article_id", "page"), "video", "page")


@query("name_conflict_guard", "SELECT canonical_id FROM v_claims WHERE attributed_to LIKE 'person%' GROUP BY canonical_id HAVING count(DISTINCT attributed_to) >= 2")
def _(t: Tables):
    n = t.v_claims.where("attributed_to LIKE 'person%'").groupBy("canonical_id").agg(F.count_distinct("attributed_to").alias("n"))
    return n.where("n >= 2").select("canonical_id")


@query("news_pick", """WITH s AS (SELECT story_id, canonical_id, max(t_start) AS recent, count(DISTINCT article_id) AS carried, count(*) FILTER (evidence = 'video') AS act FROM v_claims GROUP BY ALL) SELECT story_id, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY least(carried, 2) DESC, act DESC, carried DESC, recent DESC, canonical_id) AS rn FROM s) WHERE rn = 1""")
def _(t: Tables):
    s = t.v_claims.groupBy("story_id", "canonical_id").agg(F.max("t_start").alias("recent"), F.count_distinct("article_id").alias("carried"), F.count_if(F.col("evidence") == "video").alias("act"))
    return I.first_by(s, ["story_id"], [F.least("carried", F.lit(2)).desc(), F.desc("act"), F.desc("carried"), F.desc("recent"), F.col("canonical_id")]).select("story_id", "canonical_id")


@query("headline_candidate_pick", r"""WITH c AS (SELECT article_id, story_id, title, len(regexp_extract_all(title, '\S+')) AS n FROM v_articles), s AS (SELECT *, CASE WHEN n BETWEEN 7 AND 12 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(title, '\d') THEN 1 ELSE 0 END AS score FROM c WHERE n >= 4 AND NOT regexp_matches(title, '[#*%$]')) SELECT story_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY score DESC, article_id) AS rn FROM s) WHERE rn = 1""")
def _(t: Tables):
    n = F.size(F.regexp_extract_all("title", F.lit(r"\S+"), F.lit(0)))
    c = t.v_articles.select("article_id", "story_id", "title", n.alias("n")).where((F.col("n") >= 4) & ~F.col("title").rlike(r"[#*%$]"))
    score = F.when(F.col("n").between(7, 12), 2).otherwise(0) + F.when(F.col("title").rlike(r"\d"), 1).otherwise(0)
    return I.first_by(c.withColumn("score", score), ["story_id"], [F.desc("score"), F.col("article_id")]).select("story_id", "article_id")


@query("repeat_drop", "SELECT doc_id, paragraph, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY paragraph) AS rn FROM (SELECT doc_id, unnest(range(0, len(l))) AS paragraph, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE rn = 1")
def _(t: Tables):
    p = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).withColumn("paragraph", F.col("paragraph").cast("long"))
    return I.first_by(p, ["doc_id", "line"], [F.col("paragraph")])


@query("paragraph_plan", """WITH RECURSIVE e AS (SELECT DISTINCT x.canonical_id AS a, y.canonical_id AS b FROM v_claims x JOIN v_claims y ON x.story_id = y.story_id AND x.attributed_to = y.attributed_to AND x.canonical_id <> y.canonical_id AND x.attributed_to LIKE 'person %' AND x.stance = 'denies' AND y.stance = 'denies'), r AS (SELECT DISTINCT a AS node, a AS lab FROM e UNION SELECT e.b, r.lab FROM r JOIN e ON r.node = e.a WHERE r.lab < e.b) SELECT node, min(lab) AS component FROM r GROUP BY node""")
def _(t: Tables):
    v = t.v_claims.where("attributed_to LIKE 'person %' AND stance = 'denies'").select("story_id", "attributed_to", "canonical_id")  # partner statements: denied by the same person
    star = v.join(v.groupBy("story_id", "attributed_to").agg(F.min("canonical_id").alias("src")), ["story_id", "attributed_to"])
    return connected_components(star.select("src", F.col("canonical_id").alias("dst")))


@query("stream_run_gate", """WITH RECURSIVE g AS (SELECT user_id, min(ts::TIMESTAMP) AS t0 FROM events GROUP BY user_id UNION ALL SELECT g.user_id, (SELECT min(e.ts::TIMESTAMP) FROM events e WHERE e.user_id = g.user_id AND e.ts::TIMESTAMP >= g.t0 + INTERVAL '300' HOUR) FROM g WHERE g.t0 IS NOT NULL) SELECT user_id, count(t0) AS runs FROM g GROUP BY user_id""")
def _(t: Tables):
    events = J.event_stream(t.spark, f"{t.sf_dir}/events.parquet").select("user_id", "ts")
    return J.run_to_table(J.run_gate(events, "user_id", "ts", 300), "gate", "update", ["user_id"])


