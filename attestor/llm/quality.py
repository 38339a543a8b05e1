"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Frequent function words of the four languages of the corpus (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "de la le et les des en un une du que est pour qui dans par sur pas plus au avec ce il sont se ou "
    "der die und das von zu den mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat "
    "el los y las del al con su para lo como o sin sus le ha me si porque esta entre"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= feature <= high``; an absent bound does not bind."""

    name: str
    feature: str
    low: float | None = None
    high: float | None = None


#: Bounds on length, symbol, stop-word and line ratios.
RULES = (
    Rule("length", "n_words", low=50, high=100_000_000),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbols_per_word", high=0.10),
    Rule("marks", "marks_per_word", high=0.30),
    Rule("stop_words", "stop_word_ratio", low=0.04),
    Rule("repeated_lines", "dup_line_ratio", high=0.50),
)


def _same(a: Column, b: Column) -> Column:
    return (a["h"] == b["h"]) & (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])


def quality_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None, pinned: bool = False) -> DataFrame:
    """Adds the counts that the rules read; ``keep`` names the columns carried along (default: all).

    Three-word windows are compared inside each text: the windows' hashes are
    sorted with the words behind them as tie-breakers, so equal neighbours are
    equal windows.  Nothing is shuffled, and no user function runs.
    A null text has no words.  Columns of ``docs`` named like a feature give way to it.
    """
    features = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_stop_words"]
    kept = [F.col(f"`{c}`") for c in (keep if keep is not None else docs.columns) if c not in features]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    parts = docs.select(
        *kept,
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("__words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)).alias("__lines"),
        F.size(F.regexp_extract_all(body, F.lit(r"[#*$%&|<>]"), F.lit(0))).alias("__symbols"),
        (F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit("")))).alias("__marks"),
    )
    words = F.col("__words")
    window = lambda w, i: F.struct(
        F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
        w.alias("a"),
        F.get(words, i + 1).alias("b"),
        F.get(words, i + 2).alias("c"),
        i.alias("i"),
    )
    names = [c for c in parts.columns if c not in ("__words", "__lines", "__symbols", "__marks")]
    carried = [F.col(f"`{c}`") for c in names]
    sorted_windows = parts.select(
        *carried,
        "__lines",
        "__symbols",
        "__marks",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.sort_array(F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), window)).alias("__w"),
    )
    w = F.col("__w")
    twice = F.filter(w, lambda x, i: F.coalesce(_same(F.get(w, i - 1), x), F.lit(False)) | F.coalesce(_same(F.get(w, i + 1), x), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return sorted_windows.select(
        *carried,
        "n_words",
        "word_chars",
        F.col("__symbols").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.col("__marks").cast("long").alias("n_marks"),
        "n_stop_words",
        *([F.spark_partition_id().alias("__pin")] if pinned else []),
    )


def base_failed() -> Column:
    """Too short, or more than half of the words in three-word windows that repeat."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule table as one boolean expression over the features."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    ratio = {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "marks_per_word": F.col("n_marks") / n,
        "stop_word_ratio": F.col("n_stop_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (ratio[r.feature] >= r.low)
        if r.high is not None:
            out = out & (ratio[r.feature] <= r.high)
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Features and the verdict ``kept`` for every row of ``docs``.

    Null and empty texts fail the length rule; repeated rows are judged alike;
    an empty table gives an empty result.
    """
    judged = quality_features(docs, text, keep)
    judged = judged.drop(*[c for c in ("base_failed", "kept") if c in judged.columns])
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs`` alone.

    A filter on a computed column is pushed below the projections that compute it, with the
    column's expression written out at every mention; here that would evaluate the
    sorted windows again for each of their elements.  The partition number beside the features, which the
    optimizer may not evaluate elsewhere, keeps the filter above them.
    """
    judged = quality_features(docs.withColumnsRenamed({c: f"__doc_{c}" for c in docs.columns}), f"__doc_{text}", pinned=True)
    passed = judged.withColumn("__kept", ~base_failed() & verdict(rules)).where(F.col("__kept") & (F.col("__pin") >= 0))
    return passed.select(*[F.col(f"`__doc_{c}`").alias(c) for c in docs.columns])
