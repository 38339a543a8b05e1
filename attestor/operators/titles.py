"""Titles and roles from a registry table.

The registry (place, role, form, is_a, needs) has a row for each written form of a role, in its order: ``is_a`` names the wider role, and a form with ``needs`` counts only
where the context mentions one of these words.  Honorifics and qualifiers are words that may stand in a title besides those of the forms; only the
former, and words of forms, are evidence of a person.  Registries are word lists of some thousand entries; the word sets drawn from one are counted before they travel with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.linking import ancestors
from attestor.plans.durable import durable, small

#: Words that join the parts of a title, and words that open a sentence and are no part of one (fixed values).
JOINTS = ["of", "the"]
OPENERS = """monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december the a an while meanwhile when after
before on in at by for from according however but and also later earlier then since as if with""".split()
#: Words of a registry that may travel with every row.
MOST_WORDS = 100_000
_NEAR = 5


def plain_title(phrase: Column) -> Column:
    """Lower case without full stops and commas, one space between words."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(phrase, "[.,]", ""), r"\s+", " ")))


def roles_of(phrases: DataFrame, registry: DataFrame) -> DataFrame:
    """``(phrase, context, role)``: the role that a written title is, in its context; a title that is none has no row.

    The first form whose needs are met comes before the first one without needs; the title itself is part of its context.  Nulls count as empty.
    """
    asked = phrases.select("phrase", "context").distinct().withColumn("__form", plain_title(F.coalesce("phrase", F.lit(""))))
    forms = registry.select(plain_title(F.col("form")).alias("__form"), "place", "role", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    around = F.concat_ws(" ", "context", "phrase")
    met = F.exists("needs", lambda n: F.regexp_like(around, F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}_])\Q"), n, F.lit(r"\E(?![\p{L}\p{M}\p{N}_])"))))
    free = F.size("needs") == 0
    rows = asked.join(small(forms), "__form").where(free | met)
    return rows.groupBy("phrase", "context").agg(F.min(F.struct(free.alias("free"), "place", "role")).alias("best")).select("phrase", "context", "best.role")


def title_relations(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """``(a, b, context, relation)`` of pairs of titles: same (one role), a_is_b (a is a kind of b), b_is_a, or null."""
    asked = durable(pairs.select("a", "b", "context").distinct(), "titles")
    roles = durable(roles_of(asked.select(F.col("a").alias("phrase"), "context").unionByName(asked.select(F.col("b").alias("phrase"), "context")), registry), "roles")
    wider = ancestors(registry.where("is_a IS NOT NULL").select("role", "is_a").distinct(), "role", "is_a").select("node", "ancestor").withColumn("__up", F.lit(True))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    side = lambda n: roles.select(F.col("phrase").alias(f"__{n}"), F.col("context").alias(f"__c{n}"), F.col("role").alias(f"__r{n}"))
    both = asked.join(side("a"), same("a", "__a") & same("context", "__ca"), "left").join(side("b"), same("b", "__b") & same("context", "__cb"), "left")
    up = lambda x, y, name: wider.select(F.col("node").alias(x), F.col("ancestor").alias(y), F.col("__up").alias(name))
    found = both.join(up("__ra", "__rb", "__ab"), ["__ra", "__rb"], "left").join(up("__rb", "__ra", "__ba"), ["__ra", "__rb"], "left")
    return found.select("a", "b", "context", F.when(F.col("__ra") == F.col("__rb"), "same").when(F.col("__ab"), "a_is_b").when(F.col("__ba"), "b_is_a").alias("relation"))


def title_words(registry: DataFrame, honorifics: list[str], qualifiers: list[str]) -> tuple[Column, Column]:
    """``(words, evidence)`` as array literals: words that may stand in a title, and those of them that tell of a person."""
    parts = registry.select(F.split(F.trim("form"), r"\s+").alias("w")).select(F.explode("w").alias("word"), (F.size("w") == 1).alias("alone"))
    parts = parts.select(F.regexp_replace("word", r"^\.+|\.+$", "").alias("word"), "alone").where(~F.lower("word").isin("of", "the", "and") & (F.col("word") != ""))
    found = parts.groupBy("word").agg(F.max("alone").alias("alone")).limit(MOST_WORDS + 1).collect()
    if len(found) > MOST_WORDS:
        raise ValueError("a registry of titles is a word list; this one has too many words")
    words = sorted({r.word for r in found} | set(honorifics) | set(qualifiers))
    evidence = sorted({r.word for r in found if r.alone or r.word not in qualifiers} | set(honorifics))
    return tuple(F.array(*[F.lit(w) for w in x]) if x else F.array().cast("array<string>") for x in (words, evidence))


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, "^[.,;:]+|[.,;:]+$", "")


def title_before(text: Column, name: Column, words: Column, evidence: Column) -> Column:
    """The title written right before a name, or an empty string.

    Words are taken backwards while they are title words, joints between them, or capitalised words before a title word; a word that ends a clause is none
    of these.  What is taken must tell of a person, and sheds openers at its front.
    """
    found = F.regexp_extract_all(text, F.concat(F.lit(rf"((?:[\p{{L}}\p{{M}}\p{{N}}_.&'()-]+\s+){{1,{_NEAR}}})\Q"), name, F.lit(r"\E(?![\p{L}\p{M}\p{N}_-])")), F.lit(1))
    before = F.reverse(F.filter(F.split(F.coalesce(F.get(found, F.lit(0)), F.lit("")), r"\s+"), lambda w: w != ""))
    state = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(False).alias("titled"), F.lit(False).alias("over"))

    def further(s: Column, w: Column) -> Column:
        title = F.array_contains(words, _bare(w))
        joint = F.lower(_bare(w)).isin(JOINTS) & (F.size(s["taken"]) > 0)
        prefix = _bare(w).rlike("^[A-Z0-9]") & s["titled"] & ~F.lower(_bare(w)).isin(OPENERS) & ~w.rlike("[.,;:!?]$")
        goes = ~s["over"] & (title | joint | prefix)
        return F.struct(F.when(goes, F.concat(F.array(w), s["taken"])).otherwise(s["taken"]).alias("taken"), (s["titled"] | (goes & title)).alias("titled"), (~goes).alias("over"))

    taken = F.aggregate(before, state, further, lambda s: s["taken"])
    opens = lambda w: F.lower(_bare(w)).isin(OPENERS + JOINTS)
    shed = F.aggregate(taken, F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & opens(w), acc).otherwise(F.concat(acc, F.array(w))))
    return F.coalesce(F.when(F.exists(shed, lambda w: F.array_contains(evidence, _bare(w))), F.array_join(shed, " ")), F.lit(""))


def strip_title(name: Column, words: Column) -> Column:
    """A name without the titles in front of it; left alone if nothing would be left."""
    parts = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    last = F.array_max(F.transform(parts, lambda w, i: F.when(F.array_contains(words, _bare(w)), i + 1).otherwise(0)))
    return F.array_join(F.when((last > 0) & (last < F.size(parts)), F.slice(parts, last + 1, F.greatest(F.size(parts) - last, F.lit(0)))).otherwise(parts), " ")
