"""Queries of statement profiles and comparisons, names, extraction repair and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions.text import words
from attestor.operators import corroboration as C
from attestor.operators import intake as I
from attestor.operators import stories as S
from attestor.plans.q_corroboration import owners
from attestor.plans.q_text import WORDS
from attestor.plans.registry import query
from attestor.plans.tables import Tables

@query("people_ranking", r"""WITH n AS (SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\s]\s+(\p{Lu}\p{L}{2,})', 1)) AS name FROM documents) GROUP BY ALL) SELECT doc_id, name, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) AS rn FROM n) WHERE rn <= 8""")
def _(t: Tables):
    n = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^.!?\s]\s+(\p{Lu}\p{L}{2,})"), F.lit(1))).alias("name")).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return I.cap_per_group(n, ["doc_id"], [F.desc("n"), F.col("name")], 8).select("doc_id", "name", "n")


@query("title_word_learning", r"""WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '(?:^|\s)([\p{L}]+), [\p{L}]+', 1)) AS word FROM documents), e AS (SELECT lower(word) AS word, count(DISTINCT doc_id) AS docs, count(DISTINCT source) AS sources, count(*) FILTER (word = lower(word)) AS low FROM w GROUP BY ALL) SELECT word, docs, sources FROM e WHERE docs >= 3 AND sources >= 2 AND low >= 2 ORDER BY docs DESC, word LIMIT 20""")
def _(t: Tables):
    w = t.documents.select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|\s)([\p{L}]+), [\p{L}]+"), F.lit(1))).alias("word"))
    e = w.groupBy(F.lower("word").alias("word")).agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("sources"), F.count_if(F.col("word") == F.lower("word")).alias("low"))
    return e.where("docs >= 3 AND sources >= 2 AND low >= 2").orderBy(F.desc("docs"), "word").limit(20).select("word", "docs", "sources")


@query("coerce_extraction", """SELECT claim_id, CASE WHEN stance IN ('asserts', 'denies') THEN stance ELSE 'asserts' END AS stance, left(attributed_to, 8) AS attributed_to, least(t_start, t_end) AS t_start FROM v_claims""")
def _(t: Tables):
    raw = t.v_claims.select("claim_id", F.to_json(F.struct("stance", "attributed_to", F.struct(F.col("t_end").alias("start"), F.col("t_start").alias("end")).alias("time"))).alias("j"))
    x = raw.select("claim_id", F.from_json("j", "stance string, attributed_to string, time struct<start: timestamp, end: timestamp>").alias("x"))
    return x.select("claim_id", F.when(F.col("x.stance").isin("asserts", "denies"), F.col("x.stance")).otherwise("asserts").alias("stance"), F.left("x.attributed_to", F.lit(8)).alias("attributed_to"), F.least("x.time.start", "x.time.end").alias("t_start"))


@query("compound_split_check", r"""WITH s AS (SELECT doc_id, text, list_filter(string_split(text, '. '), lambda x: length(x) > 0) AS p FROM documents) SELECT doc_id, len(p)::INT AS pieces, len(regexp_extract_all(array_to_string(p, ' '), '\d+')) = len(regexp_extract_all(text, '\d+')) AS numbers_kept FROM s""")
def _(t: Tables):
    s = t.documents.select("doc_id", "text", F.filter(F.split("text", r"\. "), lambda x: F.length(x) > 0).alias("p"))
    n = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))
    return s.select("doc_id", F.size("p").alias("pieces"), (n(F.array_join("p", " ")) == n(F.col("text"))).alias("numbers_kept"))


@query("global_clusters")
def _(t: Tables):
    a = C.global_affinity(C.pairwise_agreement(C.stance_matrix(t.v_claims, owners(t))))
    trials = S.spectral_trials(a)
    best = trials.groupBy("k").agg(F.first("silhouette").alias("s")).agg(F.max_by("k", "s").alias("k"))
    return trials.join(F.broadcast(best), "k")  # one row


STEM = "regexp_replace(x, '(ingly|edly|ation|tion|ing|ed|ly|es|s)$', '')"


@query("root_words", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter({WORDS}, lambda x: length(x) > 4 AND x NOT IN ('their', 'there', 'which')), lambda x: {STEM}))), ' ') AS roots FROM documents")
def _(t: Tables):
    w = F.filter(words(F.col("text")), lambda x: (F.length(x) > 4) & ~x.isin("their", "there", "which"))
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(w, lambda x: F.regexp_replace(x, "(ingly|edly|ation|tion|ing|ed|ly|es|s)$", "")))), " ").alias("roots"))


NAMES = r"list_distinct(regexp_extract_all(text, '[^.!?\s]\s+(\p{Lu}\p{L}{2,})', 1))"


@query("unsupported_person", f"WITH p AS (SELECT conv_id, turn, {NAMES} AS names, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_filter(names, lambda x: NOT contains(src, x))), ',') AS absent FROM p WHERE src IS NOT NULL")
def _(t: Tables):
    from pyspark.sql import Window as W

    n = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^.!?\s]\s+(\p{Lu}\p{L}{2,})"), F.lit(1)))
    p = t.conversations.select("conv_id", "turn", n.alias("names"), F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("src")).where("src IS NOT NULL")
    return p.select("conv_id", "turn", F.array_join(F.array_sort(F.filter("names", lambda x: ~F.contains(F.col("src"), x))), ",").alias("absent"))


@query("topic_proposals", "WITH r AS (SELECT story_id, loaded_word, canonical_id, ceil(row_number() OVER (PARTITION BY story_id, loaded_word ORDER BY canonical_id) / 12.0)::BIGINT AS part FROM (SELECT DISTINCT story_id, loaded_word, canonical_id FROM v_claims)) SELECT story_id, loaded_word, part, count(*) AS n, min(canonical_id) AS first_id FROM r GROUP BY ALL")
def _(t: Tables):
    from pyspark.sql import Window as W

    d = t.v_claims.select("story_id", "loaded_word", "canonical_id").distinct()
    part = F.ceil(F.row_number().over(W.partitionBy("story_id", "loaded_word").orderBy("canonical_id")) / 12.0)
    return d.withColumn("part", part).groupBy("story_id", "loaded_word", "part").agg(F.count(F.lit(1)).alias("n"), F.min("canonical_id").alias("first_id"))
