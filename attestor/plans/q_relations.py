"""Queries of statements, what they say, and what two of a story have to do with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import figures as G
from attestor.functions import relations as R
from attestor.plans.registry import query
from attestor.plans.tables import Tables


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_STEM = f"CASE WHEN length(x) > 4 THEN regexp_replace(x, '{R.SUFFIX}', '') ELSE x END"
_MEANING = "CASE " + " ".join(f"WHEN x IN {_list(stems)} THEN '{one}'" for stems, one in R.meanings()) + " ELSE x END"
_DAY = "lower(substr(regexp_extract(text, {p}, {m}), 1, 3)) || regexp_extract(text, {p}, {d})"
#: A figure in digits by its whole writing, as in ``figures``: 1.2.3 is none, commas go, ordinals, basis points and scales count.
_SCALES = G.SCALES | G.AFTER_DIGITS
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_DIGITS = rf"\d+(?:[.,]\d+)*(?:(?:st|nd|rd|th)\b|{_SPACE}*(?:basis{_SPACE}+points?|bps)\b|(?:{_SPACE}*(?:{'|'.join(sorted(_SCALES, key=len, reverse=True))})\b)+)?"
#: Letters beyond ASCII become an underscore there, so that a word ends where it does in the query.
_WRITTEN = r"lower(regexp_replace(translate(undated, '०१२३४५६७८९٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), '[^\P{L}a-zA-Z]', '_', 'g'))"
_SCALE = "CASE " + " ".join(f"WHEN w = '{w}' THEN {v}::DOUBLE" for w, v in _SCALES.items()) + " ELSE 1.0::DOUBLE END"
_VALUE = "TRY_CAST(replace(regexp_extract(x, '^[0-9.,]+'), ',', '') AS DOUBLE)"
_FIGURES = f"list_transform(list_filter(list_transform(regexp_extract_all({_WRITTEN}, '{_DIGITS}'), lambda x: CASE WHEN regexp_matches(x, '(points?|bps)$') THEN {_VALUE} / 100 ELSE list_reduce(list_concat([{_VALUE}], list_transform(regexp_extract_all(x, '[a-z]+'), lambda w: {_SCALE})), lambda v, w: v * w) END), lambda x: x IS NOT NULL), lambda x: round(x, 3))"
WHOLE = "p0 AS (SELECT statement_id AS id, story_id, coalesce(text, '') AS text FROM v_told)"
BODY = f"""p00 AS (SELECT statement_id AS id, story_id, regexp_replace(coalesce(text, ''), {_quoted(R.ACCORDING)}, '', 'g') AS t FROM v_told), p01 AS (SELECT *, regexp_extract(t, {_quoted(R.SAID)}, 1) AS said FROM p00),
p0 AS (SELECT id, story_id, CASE WHEN length(t) - length(said) > 15 THEN substr(t, length(said) + 1) ELSE t END AS text FROM p01)"""
PROFILE = rf"""p1 AS (SELECT *, regexp_replace(text, {_quoted(R.DATE)}, ' ', 'g') AS undated, regexp_extract_all(text, '{R.TOKEN.replace("'", "''")}', 1) AS tokens FROM p0),
p AS (SELECT id, story_id, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g')) AS plain,
  list_distinct(list_transform(list_filter(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN {_list(R.STOP)} AND NOT regexp_matches(x, '^[0-9]+$')), lambda x: {_STEM}), lambda x: x NOT IN {_list(R.NO_ROOTS)}), lambda x: {_MEANING})) AS words,
  list_distinct({_FIGURES}) AS figures,
  list_filter(list_distinct(list_transform(list_transform(list_filter(tokens, lambda x, i: regexp_matches(x, '^\p{{Lu}}.') AND (i > 1 OR (regexp_matches(coalesce(tokens[2], ''), '^\p{{Lu}}') AND lower(x) NOT IN {_list(R.STOP)}))), lambda x: lower(x)), lambda x: {_STEM})), lambda x: x NOT IN {_list(R.NO_NAMES)}) AS names,
  list_distinct(regexp_extract_all(text, '\b((?:19|20)\d\d)\b', 1)) AS years, coalesce(nullif({_DAY.format(p=_quoted(R.DAY_MONTH), m=2, d=1)}, ''), nullif({_DAY.format(p=_quoted(R.MONTH_DAY), m=1, d=2)}, ''), nullif(regexp_extract(text, '\b(?:19|20)\d\d-(\d\d-\d\d)\b', 1), '')) AS day,
  list_distinct(list_transform(regexp_extract_all(text, '{R.WEEKDAY}', 1), lambda x: lower(x))) AS weekdays, regexp_matches(text, {_quoted(R.DENIAL)}) AS denies, regexp_matches(text, '{R.ELSEWHERE}') AS elsewhere,
  regexp_matches(text, '{R.AT_LEAST}') AS at_least, regexp_matches(text, '{R.AT_MOST}') AS at_most, regexp_extract(text, '\b\d+ (?:out )?of (?:the )?(\d+)\b', 1) AS total FROM p1)"""


def _minus(x: str, y: str) -> str:
    return f"list_filter({x}, lambda z: NOT list_contains({y}, z))"


def _direction(w: str, n: str) -> str:
    return f"""len({_minus(f'{n}.figures', f'{w}.figures')}) = 0 AND len({_minus(f'{n}.names', f'{w}.names')}) = 0 AND len(own_{w}) > len(own_{n}) AS {w}_holds,
  CASE WHEN len(own_{n}) = 0 THEN 1.0 ELSE common::DOUBLE / len(own_{n}) END AS {w}_share, len({_minus(f'own_{n}', f'own_{w}')}) AS {w}_lacks, {w}.elsewhere AND NOT {n}.elsewhere AS {w}_strays, len(own_{n}) AS {n}_size"""


def _disjoint(x: str) -> str:
    return f"(len(a.{x}) > 0 AND len(b.{x}) > 0 AND len(list_intersect(a.{x}, b.{x})) = 0)"


_COVERS = "{w}_holds AND {n}_size >= 3 AND {w}_share >= " + str(R.COVERING)
_NEARLY = "{w}_holds AND {n}_size >= 2 AND {w}_lacks <= 1 AND {w}_share >= " + str(R.NEARLY)
FEATURES = f"""j AS (SELECT a, b, {_minus('a.words', 'list_intersect(a.names, b.names)')} AS own_a, {_minus('b.words', 'list_intersect(a.names, b.names)')} AS own_b FROM p a JOIN p b ON a.story_id = b.story_id AND a.id < b.id),
k AS (SELECT *, len(list_intersect(own_a, own_b)) AS common FROM j),
f AS (SELECT *, a.denies <> b.denies AS opposed, {_disjoint('years')} OR coalesce(a.day <> b.day, false) AS dated_apart, a.plain = b.plain AS identical,
  len({_minus('a.figures', 'b.figures')}) + len({_minus('b.figures', 'a.figures')}) = 0 AS figures_equal, len({_minus('a.names', 'b.names')}) + len({_minus('b.names', 'a.names')}) = 0 AS names_equal,
  CASE WHEN len(own_a) + len(own_b) = 0 THEN 1.0 ELSE common::DOUBLE / (len(own_a) + len(own_b) - common) END AS alike, len(a.figures) > 0 OR len(a.names) > 0 OR len(own_a) >= 3 AS telling, {_direction('a', 'b')}, {_direction('b', 'a')} FROM k)"""
RELATION = f"""CASE WHEN opposed OR dated_apart THEN 'different' WHEN identical OR (figures_equal AND names_equal AND alike >= {R.EQUAL}) THEN 'same'
  {" ".join(f"WHEN {_COVERS.format(w=w, n=n)} THEN CASE WHEN figures_equal AND NOT {w}_strays THEN '{w}_covers_{n}' ELSE 'ask_{w}_covers_{n}' END" for w, n in (('a', 'b'), ('b', 'a')))}
  WHEN figures_equal AND names_equal AND alike >= {R.DOUBTFUL} AND telling THEN 'ask' {" ".join(f"WHEN {_NEARLY.format(w=w, n=n)} THEN 'ask_{w}_covers_{n}'" for w, n in (('a', 'b'), ('b', 'a')))} ELSE 'different' END"""


def _near(x: str, y: str) -> str:
    return f"len(list_filter({x}, lambda v: len(list_filter({y}, lambda w: abs(v - w) <= 0.05 * greatest(abs(v), abs(w)))) = 0)) = 0"


_BOUNDS = " OR ".join(
    f"({x}.{bound} AND list_{one}({y}.figures) {sign} list_{other}({x}.figures))" for x, y in (("a", "b"), ("b", "a")) for bound, one, sign, other in (("at_least", "max", ">=", "min"), ("at_most", "min", "<=", "max"))
)
DISPUTE = f"""g AS (SELECT *, {' , '.join(f"list_filter({_minus(f'{x}.words', f'{x}.names')}, lambda z: z NOT IN {_list(R.ANSWERS)}) AS q{x}" for x in 'ab')},
  CASE WHEN len(a.figures) <= len(b.figures) THEN {_near('a.figures', 'b.figures')} ELSE {_near('b.figures', 'a.figures')} END AS close FROM f),
h AS (SELECT *, len(list_intersect(qa, qb)) AS asked, len(a.figures) > 0 AND len(b.figures) > 0 AND NOT close AS figures_apart FROM g),
d AS (SELECT a.id AS a, b.id AS b, CASE WHEN NOT names_equal OR len(qa) + len(qb) = 0 OR asked < {R.ONE_QUESTION} * (len(qa) + len(qb) - asked) THEN NULL WHEN opposed THEN CASE WHEN close THEN 'negation' END
  WHEN {_disjoint('weekdays')} OR dated_apart THEN 'date' WHEN figures_apart AND NOT (a.total <> '' AND b.total <> '' AND a.total <> b.total) AND NOT ({_BOUNDS}) THEN 'number' END AS kind FROM h)"""


def story_pairs(told: DataFrame) -> DataFrame:
    """The statements (statement_id, story_id, p: a profile) of each story in pairs: (a_id, b_id, a, b)."""
    side = lambda n: told.select("story_id", F.col("statement_id").alias(f"{n}_id"), F.col("p").alias(n))
    return side("a").join(side("b"), "story_id").where("a_id < b_id")


def _profiled(t: Tables, text: Column | None = None) -> DataFrame:
    return t.v_told.select("statement_id", "story_id", R.profile(F.col("text") if text is None else text).alias("p"))


@query("statement_profile", f"WITH {WHOLE}, {PROFILE} SELECT id AS statement_id, plain, array_to_string(list_sort(words), ' ') AS words, array_to_string(list_sort(names), ' ') AS names, len(figures)::INT AS figures, array_to_string(list_sort(years), ' ') AS years, day, denies, elsewhere FROM p")
def _(t: Tables):
    joined = lambda c: F.array_join(F.array_sort(f"p.{c}"), " ").alias(c)
    return _profiled(t).select("statement_id", "p.plain", joined("words"), joined("names"), F.size("p.figures").alias("figures"), joined("years"), "p.day", "p.denies", "p.elsewhere")


@query("relate_statements", f"WITH {WHOLE}, {PROFILE}, {FEATURES} SELECT a.id AS a, b.id AS b, {RELATION} AS relation FROM f")
def _(t: Tables):
    return story_pairs(_profiled(t)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), R.relation(F.col("a"), F.col("b")).alias("relation"))


@query("dispute_candidate", f"WITH {BODY}, {PROFILE}, {FEATURES}, {DISPUTE} SELECT a, b, kind FROM d WHERE kind IS NOT NULL")
def _(t: Tables):
    rows = story_pairs(_profiled(t, R.body(F.col("text")))).withColumn("kind", R.dispute(F.col("a"), F.col("b")))
    return rows.where("kind IS NOT NULL").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "kind")
