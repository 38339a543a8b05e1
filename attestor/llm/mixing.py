"""Mixing sources to target weights: whole epochs first, then an Efraimidis-Spirakis order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.llm.quality import WORD
from attestor.plans.durable import durable, small

BINS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target words of each source from ``(source, source_size)``.

    Sources in code-point order (null last) weigh ``weights`` in turn and share
    ``share`` times all words.  A target stops at ``cap`` times its source's size; the
    excess goes to the others by weight until none is above.  That fixed point is
    a water level: sources are passed in the order of cap / weight, and the first
    at which the level of the rest does not exceed its cap fixes it (later ones give lower levels).  The table has one
    row for each source, so the windows without a key hold no rows of documents.
    """
    cycle = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    every = W.partitionBy()
    by_level = W.orderBy(F.col("__cap") / F.col("__weight"), F.col("source").asc_nulls_last())
    t = (
        sizes.withColumn("__weight", cycle)
        .withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("__pot", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("__full", F.sum("__cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("__rest", F.sum("__weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("__level", (F.col("__pot") - F.coalesce(F.col("__full"), F.lit(0.0))) / F.col("__rest"))
        .withColumn("__level", F.max(F.when(F.col("__level") * F.col("__weight") <= F.col("__cap"), F.col("__level"))).over(every))
    )
    wanted = F.coalesce(F.least(F.col("__cap"), F.col("__level") * F.col("__weight")), F.col("__cap"))
    return t.select("source", "source_size", wanted.alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the md5 of the key: the same on every run and engine."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(2**52))


def mix_sources(docs: DataFrame, quality: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", text: str = "text") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, source)`` for every document.

    ``taken`` counts complete epochs of the source and, for what is left of the
    target, documents in the ascending order of exponential keys -ln(u) / quality
    (Efraimidis and Spirakis), prefix-summed to the budget; the document at the
    edge is taken if that brings the sum nearer.  The prefix sums run over bins of
    the key (one row for each source and bin); only the bin that holds the edge is
    sorted, so a source with a third of all rows is never sorted in one task.

    ``quality`` is a positive weight of a document (default: from symbols and
    length).  A null or empty text has size 0 and is taken whole wherever it
    falls; a null source is a source of its own; equal keys fall in the order of
    doc_id and size.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    count = F.size(F.regexp_extract_all(body, F.lit(WORD), F.lit(0))).cast("long")
    symbols = F.size(F.regexp_extract_all(body, F.lit(r"[#*$%&|<>]"), F.lit(0)))
    rows = docs.select("doc_id", "source", count.alias("size"), symbols.alias("__symbols"), *([] if quality is None else [quality.alias("__quality")]))
    if quality is None:
        good = F.greatest(F.lit(0.1), F.lit(1.0) - F.col("__symbols") / F.greatest(F.col("size"), F.lit(1))) * F.least(F.lit(1.0), (F.col("size") + 10) / 100.0)
        rows = rows.withColumn("__quality", good)
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.col("__quality")
    sized = durable(
        rows.select("doc_id", "source", "size", key.alias("__key")).withColumn("__bin", F.floor(F.lit(BINS) * (1 - F.exp(-F.col("__key")))).cast("int")),
        "mix",
    )
    binned = sized.groupBy("source", "__bin").agg(F.sum("size").alias("__in_bin"))
    targets = source_targets(binned.groupBy("source").agg(F.sum("__in_bin").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = targets.withColumn("__epochs", epochs).withColumn("__budget", F.col("target") - F.col("__epochs") * F.col("source_size"))
    before = F.coalesce(F.sum("__in_bin").over(W.partitionBy("source").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = (
        binned.withColumn("__before", before)
        .join(budgets.select(F.col("source").alias("__s"), "__budget"), F.col("source").eqNullSafe(F.col("__s")))
        .where(F.col("__before") + F.col("__in_bin") >= F.col("__budget"))
        .groupBy("source")
        .agg(F.min(F.struct("__bin", "__before")).alias("__edge"))
        .select(F.col("source").alias("__e"), F.col("__edge.__bin").alias("__edge_bin"), F.col("__edge.__before").alias("__edge_before"))
    )
    plan = budgets.join(edge, F.col("source").eqNullSafe(F.col("__e")), "left").drop("__e").withColumnRenamed("source", "__s")
    # one row for each source: written down, counted and then broadcast, so a hot source's documents are not dealt by it
    placed = sized.join(small(durable(plan, "mix-plan")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    at_edge = F.col("__bin") == F.col("__edge_bin")
    run = W.partitionBy("source", "__bin").orderBy("__key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.where(at_edge).withColumn("__run", F.col("__edge_before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    inside = inside.withColumn("__extra", F.col("__run") + F.col("size") / 2 <= F.col("__budget")).drop("__run")
    others = placed.where(~F.coalesce(at_edge, F.lit(False))).withColumn("__extra", F.col("__edge_bin").isNull() | (F.col("__bin") < F.col("__edge_bin")))
    both = inside.unionByName(others)
    extra = F.when(F.col("__budget") > 0, F.col("__extra")).otherwise(F.lit(False))
    copies = (F.col("__epochs") + extra.cast("long")).alias("copies")
    return both.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies, "source")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents as often as the mix takes them (0, 1 or 2 times); rows alike in doc_id and source share the larger count."""
    counts = durable(mix_sources(docs, **settings).groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s")).agg(F.max("copies").alias("__copies")).where("__copies > 0"), "copies")
    joined = docs.join(small(counts), docs["doc_id"].eqNullSafe(F.col("__d")) & docs["source"].eqNullSafe(F.col("__s")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*columns)
