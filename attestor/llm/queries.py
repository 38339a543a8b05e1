"""The queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import collocations, decontam, hard_negatives, html_text, language_id, mixing, pii, quality, sharding, simhash, substring, token_output, warc
from attestor.plans.durable import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
f AS (SELECT rid, doc_id, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(body) - length(replace(body, '!', '')) AS n_marks FROM d),
pos AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM f WHERE len(w) > 2),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM pos),
dup AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE n > 1) GROUP BY rid),
c AS (SELECT f.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, n_marks,
  len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop FROM f LEFT JOIN rep ON f.rid = rep.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words <= 100000000
  AND word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 2.0 AND 15.0 AND n_symbols::DOUBLE / greatest(n_words, 1) <= 0.10
  AND n_marks::DOUBLE / greatest(n_words, 1) <= 0.30 AND n_stop::DOUBLE / greatest(n_words, 1) >= 0.04
  AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.50 AS kept FROM c
"""


@query("op9_quality_rules", QUALITY_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_feistel_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"))
    placed = sharding.shard_rows(rows, 24, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
  (sum(source_size) OVER ())::DOUBLE * 1.5 AS pot FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
v AS (SELECT *, (pot - full_) / rest AS level FROM l),
t AS (SELECT source, source_size, coalesce(least(cap, max(CASE WHEN level * w <= cap THEN level END) OVER () * w), cap)::DOUBLE AS target FROM v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
k AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
  -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
  / (greatest(0.1::DOUBLE, 1.0::DOUBLE - symbols::DOUBLE / greatest(size, 1)) * least(1.0::DOUBLE, (size + 10)::DOUBLE / 100.0::DOUBLE)) AS key
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN budget > 0 AND run + size / 2.0 <= budget THEN size ELSE 0 END)::BIGINT AS taken FROM p
"""


@query("op7_weighted_mix", MIXING_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("copies", "source")


@query("op2_simhash_components")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_warc_round_trip")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path, with_html=False).drop("url", "html")


@query("op10_pii_pseudonyms")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.secret_key(spark)).select("doc_id", "n_values", "kinds", "text")


@query("op5_html_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))

_FAMILIES = [*range(decontam.LEAST, decontam.SPAN), *sorted(decontam.MASKS)]


def _seed_sql(rows: str, key: str, own: str = "true") -> str:
    """A row for each mask at each place where it fits; ``own`` tells the family of a row."""
    return " UNION ALL ".join(
        f"SELECT {key}, x, '{f}-{i}' AS m, concat_ws(' ', {', '.join(f'w[x + {p + 1}]' for p in mask)}) AS seed FROM {rows} WHERE x + {mask[-1] + 1} <= len(w) AND {own.format(f=f)}"
        for f in _FAMILIES
        for i, mask in enumerate(decontam.masks(f))
    )


DECONTAM_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents),
b AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM benchmark) WHERE len(w) >= {decontam.LEAST} GROUP BY w),
dx AS (SELECT doc_id, w, unnest(range(0, len(w))) AS x FROM d),
bx AS (SELECT item_id, w, CASE WHEN len(w) < {decontam.SPAN} THEN len(w) {" ".join(f"WHEN len(w) < {high} THEN {low}" for low, high in zip(sorted(decontam.MASKS), sorted(decontam.MASKS)[1:]))} ELSE {max(decontam.MASKS)} END AS family,
  unnest(range(0, len(w))) AS x FROM b),
bs AS ({_seed_sql('bx', 'item_id', 'family = {f}')}), ds AS (SELECT * FROM ({_seed_sql('dx', 'doc_id')}) WHERE seed IN (SELECT seed FROM bs)),
hits AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.x - bs.x AS shift FROM ds JOIN bs ON ds.m = bs.m AND ds.seed = bs.seed),
f AS (SELECT h.doc_id, h.item_id, h.shift, least({decontam.WINDOW}, len(b.w)) AS win,
  list_transform(range(0, len(b.w)), lambda j: CASE WHEN h.shift + j >= 0 AND d.w[h.shift + j + 1] = b.w[j + 1] THEN 1 ELSE 0 END) AS m
  FROM hits h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id),
s AS (SELECT doc_id, item_id, shift, win, list_max(list_transform(range(0, len(m) - win + 1), lambda k: list_sum(m[k + 1:k + win])))::BIGINT AS matched FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift) AS rn FROM s
  WHERE matched >= win * CASE WHEN win < {decontam.SPAN} THEN 1.0 ELSE {decontam.AGREE} END)
SELECT doc_id, item_id, matched, win::BIGINT AS "window", shift::BIGINT AS shift FROM o WHERE rn = 1
"""


@query("op6_spaced_seed_decontamination", DECONTAM_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op1_paragraph_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_paragraphs(_table(spark, sf_dir, "documents"))


@query("op3_token_blocks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, _table(spark, sf_dir, "documents"))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Writes the documents' ids, reads the files and tells what they hold."""
    path = fresh_path(spark, "ids")
    token_output.write_tokens(docs, path, public_tokenizers.path(tokenizer))
    return token_output.read_tokens(spark, path)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COLLOCATION_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS body FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(body, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM g) GROUP BY lang, phrase, k HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS v, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, (c.a::HUGEINT * 2000000) // (x.f::HUGEINT + y.f) AS score FROM c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.v[1:cut], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.v[cut + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM s),
h AS (SELECT lang, part, max(f) AS longer FROM (SELECT c.lang, c.a AS f, unnest(list_transform(range(1, c.k - m + 2), lambda i: array_to_string(c.v[i:i + m - 1], ' '))) AS part
  FROM c, (VALUES (2), (3)) AS sizes(m) WHERE c.cut = 1 AND m < c.k) GROUP BY lang, part),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.part = b.phrase
  WHERE place = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a))
SELECT o.lang, rank::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


@query("op13_collocations", COLLOCATION_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


HARD_NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
"""


@query("op12_hard_negatives", HARD_NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("id") % 50 == 0)


@query("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    model = language_id.learn(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
