"""Column functions on statements: figures, names, comparisons, colours, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the colours, weakest first (fixed values).
COLOURS = ("disputed", "unverified", "developing", "single", "partial", "corroborated")


def digit_figures(text: Column) -> Column:
    """Numbers written in digits as values: thousands separators dropped; lakh, crore, million and bps scaled."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\d[\d,]*(?:\.\d+)?(?: ?(?:lakh|crore|million|bps))?)"), F.lit(1))

    def value(x):
        n = F.regexp_replace(F.regexp_extract(x, r"^([\d,.]+)", 1), ",", "").cast("double")
        return F.round(n * F.when(x.endswith("lakh"), 1e5).when(x.endswith("crore"), 1e7).when(x.endswith("million"), 1e6).when(x.endswith("bps"), 0.01).otherwise(1.0), 6)

    return F.transform(found, value)


def capital_names(text: Column) -> Column:
    """Words that begin with a capital and are not the first, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^.!?\s]\s+(\p{Lu}\p{L}{2,})"), F.lit(1)))


def within_edit(a: Column, b: Column, share: float = 0.4) -> Column:
    """Two spellings of one word: the same first letter and an edit distance within a share of the longer."""
    return (F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & (F.levenshtein(a, b) <= share * F.greatest(F.length(a), F.length(b)))


def values_agree(a: Column, b: Column, approximate: Column) -> Column:
    """Equal within 0.5 %, or 5 % where either is approximate."""
    tolerance = F.when(approximate, 0.05).otherwise(0.005)
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def colour(verdict: Column, groups: Column, folded: Column) -> Column:
    """Shade of a statement: one independent group is single, or partial if others were folded in."""
    return F.when(verdict.isin("disputed", "unverified"), verdict).when((groups <= 1) & (folded > 0), "partial").when(groups <= 1, "single").otherwise(verdict)


def colour_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in COLOURS]), c)


def iso_minutes(text: Column) -> Column:
    """One of four accepted time formats cut to minutes, else null."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd HH:mm")
