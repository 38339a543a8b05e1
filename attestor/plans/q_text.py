"""Queries of scalar functions on text, names, numbers and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import text as X
from attestor.plans.durable import durable
from attestor.plans.registry import query
from attestor.plans.tables import Tables

WORDS = r"regexp_extract_all(lower(text), '([\p{L}\p{M}\p{N}_]+)', 1)"
SHINGLES = f"""w AS (SELECT doc_id, {WORDS} AS t FROM documents), s AS (SELECT doc_id, CASE WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) END AS sh FROM w)"""
HASH = "(('0x' || substr(md5(x), 1, 8))::BIGINT % 2147483647)"
SIGNATURE = f"m AS (SELECT doc_id, list_transform(range(1, 65), lambda i: list_min(list_transform(hs, lambda h: ((i * 1103515245 + 12345) % 2147483647 * h + i * 7919) % 2147483647))) AS sig FROM (SELECT doc_id, list_transform(sh, lambda x: {HASH}) AS hs FROM s))"


@query("shingles", f"WITH {SHINGLES} SELECT doc_id, len(sh)::INT AS n, list_min(sh) AS least, md5(array_to_string(list_sort(sh), '|')) AS digest FROM s")
def _(t: Tables):
    s = t.documents.select("doc_id", X.words(F.col("text")).alias("t")).select("doc_id", X.shingle_set(F.col("t")).alias("sh"))
    return s.select("doc_id", F.size("sh").alias("n"), F.array_min("sh").alias("least"), F.md5(F.array_join(F.array_sort("sh"), "|")).alias("digest"))


@query("minhash_signature", f"WITH {SHINGLES}, {SIGNATURE} SELECT doc_id, array_to_string(sig, ',') AS signature FROM m")
def _(t: Tables):
    s = t.documents.select("doc_id", X.minhash(X.words(F.col("text"))).alias("sig"))
    return s.select("doc_id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("signature"))


@query("minhash_jaccard", f"WITH {SHINGLES}, {SIGNATURE} SELECT a.doc_id AS a, b.doc_id AS b, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.sig[i] = b.sig[i] THEN 1 ELSE 0 END))::DOUBLE / 64 AS estimate FROM m a JOIN m b ON b.doc_id // 8 = a.doc_id // 8 AND a.doc_id < b.doc_id")
def _(t: Tables):
    s = durable(t.documents.select("doc_id", X.minhash(X.words(F.col("text"))).alias("sig")).withColumn("story", F.expr("doc_id div 8")), "signatures")
    b = s.select("story", F.col("doc_id").alias("b"), F.col("sig").alias("other"))
    return s.join(b, "story").where("doc_id < b").select(F.col("doc_id").alias("a"), "b", X.equal_share(F.col("sig"), F.col("other")).alias("estimate"))


AG = [("PTI", r"\bPTI\b|Press Trust"), ("ANI", r"\bANI\b|Asian News"), ("Reuters", r"\bReuters\b"), ("AFP", r"\bAFP\b"), ("AP", r"\bAP\b|Associated Press")]
TAG = "CASE " + " ".join(f"WHEN regexp_matches(coalesce({p}, ''), '{r}') THEN '{n}'" for p in ("author", "substr(text, 1, 300)", "right(text, 200)") for n, r in AG) + " END"


@query("agency_tag", f"SELECT article_id, {TAG} AS tag FROM (SELECT article_id, coalesce(agency, author) AS author, concat(text, CASE WHEN article_id % 17 = 0 THEN ' (AFP)' ELSE '' END) AS text FROM v_articles)")
def _(t: Tables):
    a = t.v_articles.select("article_id", F.coalesce("agency", "author").alias("author"), F.concat("text", F.when(F.col("article_id") % 17 == 0, " (AFP)").otherwise("")).alias("text"))
    return a.select("article_id", X.agency_tag(F.col("author"), F.col("text")).alias("tag"))


@query("author_key", "SELECT article_id, CASE WHEN NOT (regexp_matches(author, '(?i)staff|desk|bureau|correspondent|reporter|PTI|ANI|agenc') OR length(author) > 60) THEN concat(outlet, '::', lower(author)) END AS author_key FROM v_articles")
def _(t: Tables):
    return t.v_articles.select("article_id", X.author_key(F.col("outlet"), F.col("author")).alias("author_key"))


@query("token_estimate", r"SELECT doc_id, (floor(a / 4.0::DOUBLE + (length(text) - a) / 1.5::DOUBLE) + 1)::BIGINT AS tokens FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS a FROM documents)")
def _(t: Tables):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("figure_canon", "SELECT l_orderkey, l_linenumber, CASE WHEN v = floor(v) THEN floor(v)::BIGINT::VARCHAR ELSE round(v, 4)::VARCHAR END AS canon FROM (SELECT l_orderkey, l_linenumber, (l_quantity / 4)::DOUBLE AS v FROM lineitem)")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.figure_canon((F.col("l_quantity") / 4).cast("double")).alias("canon"))


@query("numbers_close", """WITH n AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_quantity::DOUBLE))) AS v FROM lineitem GROUP BY ALL)
SELECT a.k, CASE WHEN len(a.v) <= len(b.v) THEN list_bool_and(list_transform(a.v, lambda x: list_bool_or(list_transform(b.v, lambda y: abs(x - y) <= 0.05::DOUBLE * greatest(abs(x), abs(y)))))) ELSE list_bool_and(list_transform(b.v, lambda x: list_bool_or(list_transform(a.v, lambda y: abs(x - y) <= 0.05::DOUBLE * greatest(abs(x), abs(y)))))) END AS close FROM n a JOIN n b ON b.k = a.k + 1""")
def _(t: Tables):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(F.col("l_quantity").cast("double"))).alias("v"))
    b = n.select((F.col("k") - 1).alias("k"), F.col("v").alias("w"))
    return n.join(b, "k").select("k", X.numbers_close(F.col("v"), F.col("w")).alias("close"))


@query("number_symmetric_diff", """WITH n AS (SELECT l_orderkey AS k, list_distinct(list(l_quantity::INT)) AS v FROM lineitem GROUP BY ALL)
SELECT a.k, array_to_string(list_sort(list_concat(list_filter(a.v, lambda x: NOT list_contains(b.v, x)), list_filter(b.v, lambda x: NOT list_contains(a.v, x)))), ',') AS diff FROM n a JOIN n b ON b.k = a.k + 1""")
def _(t: Tables):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_quantity").cast("int")).alias("v"))
    b = n.select((F.col("k") - 1).alias("k"), F.col("v").alias("w"))
    both = F.array_sort(F.array_union(F.array_except("v", "w"), F.array_except("w", "v")))
    return n.join(b, "k").select("k", F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("diff"))


SKEL = r"regexp_replace(translate(regexp_replace(regexp_replace(translate(lower(x), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'ph', 'f', 'g'), 'ck', 'k', 'g'), 'cqzw', 'kksv'), '[aeiouyh]|[^a-z]', '', 'g')"
for _c in "bcdfgjklmnpqrstvwxz":
    SKEL = f"regexp_replace({SKEL}, '{_c}+', '{_c}', 'g')"


@query("consonant_skeleton", f"SELECT doc_id, array_to_string(list_transform({WORDS}, lambda x: {SKEL}), ' ') AS skeleton FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.array_join(F.transform(X.words(F.col("text")), X.skeleton), " ").alias("skeleton"))


@query("lenient_json", r"""SELECT conv_id, turn, nullif(regexp_replace(regexp_extract(regexp_replace(x, '```(json)?', '', 'g'), '(?s)(\{.*\})', 1), ',\s*([}\]])', '\1', 'g'), '') AS body FROM (SELECT conv_id, turn, concat('noise ```json {"role": "', role, '", "n": [1, 2,],} ``` ', turn::VARCHAR) AS x FROM conversations)""")
def _(t: Tables):
    x = F.concat(F.lit('noise ```json {"role": "'), "role", F.lit('", "n": [1, 2,],} ``` '), F.col("turn").cast("string"))
    return t.conversations.select("conv_id", "turn", X.lenient_json(x).alias("body"))


@query("date_of", r"""SELECT l_orderkey, l_linenumber, try_cast(nullif(regexp_extract(x, '(\d{4}-\d{2}-\d{2})', 1), '') AS DATE) AS day FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN concat('on ', strftime(l_shipdate, '%Y-%m-%d'), ' at noon') WHEN l_linenumber = 2 THEN 'on 2024-13-40' ELSE 'no day' END AS x FROM lineitem)""")
def _(t: Tables):
    x = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("on "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" at noon"))).when(F.col("l_linenumber") == 2, "on 2024-13-40").otherwise("no day")
    return t.lineitem.select("l_orderkey", "l_linenumber", X.date_of(x).alias("day"))


@query("ist_day", "SELECT log_id, (ts + INTERVAL '330' MINUTE)::DATE AS day FROM v_feed_log")
def _(t: Tables):
    return t.v_feed_log.select("log_id", X.ist_day(F.col("ts")).alias("day"))


@query("relation_text", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN concat(b, ' because ', lower(left(a, 1)), substr(a, 2), '.') ELSE concat(a, ', and after that ', b, '.') END AS sentence FROM (SELECT l_orderkey, l_linenumber, concat('Part ', l_partkey::VARCHAR, ' shipped') AS a, concat('Order ', l_orderkey::VARCHAR, ' closed') AS b FROM lineitem)")
def _(t: Tables):
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" shipped")).alias("a"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" closed")).alias("b"))
    return x.select("l_orderkey", "l_linenumber", X.relation_text(F.when(F.col("l_linenumber") % 2 == 0, "caused").otherwise("before"), F.col("a"), F.col("b")).alias("sentence"))


#: Letters, marks, digits and the underscore of any script make words: Spark's \b depends on the Java version, DuckDB's knows ASCII only.
_IN_WORD = r"\p{L}\p{M}\p{N}_"


@query("roundup_title_filter", rf"SELECT article_id FROM v_articles WHERE NOT regexp_matches(lower(title), '(live (updates|blog)|top \d+|round-?up|the the|(^|[^{_IN_WORD}])are($|[^{_IN_WORD}]))')")
def _(t: Tables):
    return t.v_articles.where(~F.lower("title").rlike(rf"(live (updates|blog)|top \d+|round-?up|the the|(?<![{_IN_WORD}])are(?![{_IN_WORD}]))")).select("article_id")


@query("query_terms", f"""SELECT doc_id, array_to_string(list_filter({WORDS}, lambda x: x NOT IN ('the', 'of', 'and', 'to', 'in', 'a', 'is') AND length(x) > 2)[1:10], ' ') AS terms FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", F.array_join(F.slice(F.filter(X.words(F.col("text")), lambda x: ~x.isin("the", "of", "and", "to", "in", "a", "is") & (F.length(x) > 2)), 1, 10), " ").alias("terms"))


@query("text_dedupe_key", f"SELECT doc_id, sha256(array_to_string(list_sort({WORDS}), ' ')) AS key FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.sha2(F.array_join(F.array_sort(X.words(F.col("text"))), " "), 256).alias("key"))


@query("word_count", r"SELECT doc_id, list_sum(list_transform(string_split(text, chr(10)), lambda l: len(regexp_extract_all(l, '[^ ]+'))))::BIGINT AS words FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.aggregate(F.split("text", "\n"), F.lit(0).cast("long"), lambda s, l: s + F.size(F.regexp_extract_all(l, F.lit("[^ ]+"), F.lit(0)))).alias("words"))


@query("concept_map", "SELECT claim_id, coalesce(c.concept, CASE WHEN regexp_matches(loaded_word, '^[a-z0-9]+$') THEN lower(loaded_word) END) AS concept FROM v_claims LEFT JOIN (SELECT DISTINCT loaded_word AS w, concat('concept ', substr(loaded_word, 2)) AS concept FROM v_claims WHERE loaded_word < 'w15') c ON loaded_word = c.w")
def _(t: Tables):
    known = t.v_claims.where("loaded_word < 'w15'").select(F.col("loaded_word").alias("w"), F.concat(F.lit("concept "), F.expr("substring(loaded_word, 2)")).alias("concept")).distinct()
    return t.v_claims.join(known, F.col("loaded_word") == F.col("w"), "left").select("claim_id", F.coalesce("concept", F.when(F.col("loaded_word").rlike("^[a-z0-9]+$"), F.lower("loaded_word"))).alias("concept"))
