"""Benchmark decontamination by spaced seeds that no overlap can be without."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.plans.durable import durable, small

#: Word positions that a seed reads, by the shortest window that the masks serve; the words between are ignored.  Every
#: window of that size or more, up to the next entry's or WINDOW, that agrees by AGREE holds one of the masks
#: somewhere, wherever its substitutions stand (tests/llm enumerates them all).
MASKS = {
    9: ((0, 1, 3, 4, 5), (0, 1, 2, 6, 7), (0, 1, 3, 5, 6)),
    15: ((0, 1, 2, 4, 5, 6), (0, 1, 3, 6, 9, 10), (0, 1, 2, 3, 7, 9)),
}
#: Benchmark texts from LEAST words, but under SPAN, must stand in a document word for word.
LEAST, SPAN = 4, min(MASKS)
#: Overlaps are judged in windows of so many words, of which so large a share must agree.
WINDOW, AGREE = 20, 0.8
#: So many words of benchmark texts are broadcast at most; beyond that the joins shuffle.
MOST_WORDS = 4_000_000


def masks(family: int) -> tuple[tuple[int, ...], ...]:
    """The masks of a family: those of the window size it is named by; under SPAN one that reads every word."""
    return MASKS.get(family) or (tuple(range(family)),)


def family_of(size: Column) -> Column:
    """The mask family of a text of ``size`` words."""
    family = F.when(size < SPAN, size)
    bounds = sorted(MASKS)
    for low, high in zip(bounds, bounds[1:]):
        family = family.when(size < high, F.lit(low))
    return family.otherwise(F.lit(bounds[-1]))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def seeds(rows: DataFrame, key: str, words: str, families: list[int], only: str | None = None) -> DataFrame:
    """``(key, at, seed)``: a hash of the words under every mask of the ``families`` at every place, or of the row's own family ``only``.

    The windows are columns of a zip of shifted arrays, so the hashing runs in generated code.
    """
    used = [(f, i, m) for f in families for i, m in enumerate(masks(f))]
    own = [only] if only else []
    hashed = rows.where(F.size(words) >= min(m[-1] + 1 for _, _, m in used)).select(key, *own, F.transform(words, lambda w: F.xxhash64(w)).alias("__h"))
    n = F.size("__h")
    shifted = [F.slice("__h", F.lit(k + 1), n).alias(f"w{k}") for k in sorted({p for _, _, m in used for p in m})]
    windows = hashed.select(key, *own, n.alias("__n"), F.posexplode(F.arrays_zip(*shifted)).alias("at", "__w"))
    under = [F.xxhash64(F.lit(f), F.lit(i), *[F.col(f"__w.w{p}") for p in m]).alias(f"m{j}") for j, (f, i, m) in enumerate(used)]
    columns = [x for j, (f, _, m) in enumerate(used) for x in (F.lit(f), F.lit(m[-1] + 1), F.col(f"m{j}"))]
    each = windows.select(key, *own, "at", "__n", *under).select(key, *own, "at", "__n", F.stack(F.lit(len(used)), *columns).alias("__f", "__k", "seed"))
    whole = each.where(F.col("at") + F.col("__k") <= F.col("__n"))
    return (whole.where(F.col("__f") == F.col(only)) if only else whole).select(key, "at", "seed")


def _flags(doc: Column, item: Column, shift: Column) -> Column:
    return F.transform(item, lambda w, j: F.when(F.get(doc, shift + j) == w, F.lit(1)).otherwise(F.lit(0)))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """``(key, item, matched, window, shift)`` for every document and benchmark text that overlap.

    Spaced seeds of both sides are joined; each hit fixes a shift between the two texts,
    along which the words are compared: an overlap holds if in some window of 20
    benchmark words (the whole text if shorter) at least 80 % stand at the same
    place in the document (all, for texts under SPAN words).  The masks of a text's family leave
    no such window without a seed, so no overlap is missed.  Only the best shift is
    returned.  Benchmark texts of fewer than LEAST words, null and empty ones among them, overlap with nothing.  Equal benchmark
    texts are one, named by the smallest id.  Documents that share a key are looked up together.
    """
    items = durable(
        benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), tokens(F.col(f"`{item_text}`")).alias("__iw"))
        .where(F.size("__iw") >= LEAST)
        .groupBy("__iw")
        .agg(F.min("item_id").alias("item_id"))
        .withColumn("__family", family_of(F.size("__iw"))),
        "items",
    )
    families = sorted(r[0] for r in items.select("__family").distinct().collect()) or [max(MASKS)]  # at most one for each length under SPAN and one for each entry of MASKS
    marks = durable(seeds(items, "item_id", "__iw", families, "__family").withColumnRenamed("at", "__p"), "seeds")
    slim = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    found = seeds(slim.select("__key", tokens(F.col("__text")).alias("__dw")), "__key", "__dw", families)
    hits = durable(found.join(small(marks), "seed").select("__key", "item_id", (F.col("at") - F.col("__p")).alias("shift")).distinct(), "hits")
    keys = hits.select(F.col("__key").alias("__k")).distinct()
    texts = slim.join(small(keys), F.col("__key").eqNullSafe(F.col("__k")), "left_semi").select(F.col("__key").alias("__k"), tokens(F.col("__text")).alias("__dw"))
    pairs = texts.join(small(hits), F.col("__key").eqNullSafe(F.col("__k"))).join(small(items.drop("__family"), MOST_WORDS, F.size("__iw")), "item_id")
    flagged = pairs.select("__key", "item_id", "shift", _flags(F.col("__dw"), F.col("__iw"), F.col("shift")).alias("__f"), F.least(F.lit(WINDOW), F.size("__iw")).alias("window"))
    f, w = F.col("__f"), F.col("window")
    sums = F.transform(F.sequence(F.lit(1), F.size(f) - w + 1), lambda s: F.aggregate(F.slice(f, s, w), F.lit(0), lambda a, x: a + x))
    best = flagged.select("__key", "item_id", "shift", "window", F.array_max(sums).alias("matched")).where(
        F.col("matched") >= F.col("window") * F.when(F.col("window") < SPAN, F.lit(1.0)).otherwise(F.lit(AGREE))
    )
    return (
        best.groupBy("__key", "item_id", "window")
        .agg(F.max(F.struct(F.col("matched"), (-F.col("shift")).alias("back"))).alias("b"))
        .select(F.col("__key").alias(key), F.col("item_id").alias(item), F.col("b.matched").cast("long").alias("matched"), F.col("window").cast("long").alias("window"), (-F.col("b.back")).cast("long").alias("shift"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that overlap with no benchmark text.

    Rows with a null key cannot be told apart: one contaminated among them removes all.
    """
    bad = durable(overlaps(docs, benchmark, key).select(F.col(key).alias("__bad")).distinct(), "contaminated")
    return docs.join(small(bad), docs[key].eqNullSafe(F.col("__bad")), "left_anti")
