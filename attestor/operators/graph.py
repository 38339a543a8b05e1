"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.plans.durable import checkpointed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components of an undirected graph: ``(node, component)``, the least node naming each.

    Alternates the large-star and small-star steps of Kiveris et al. (SOCC 2014).
    The least neighbour of a node is found by an aggregate with map-side partial
    results, so a hub with most of the edges is never gathered in a task; the
    join back to the edges has one row for each node on its small side and is
    split by AQE where a hub is skewed.  Every round ends in a reliable
    checkpoint.  Self loops, repeated edges and null ends are dropped; a node
    without an edge to another node has no row.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    e = checkpointed(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = None
    while True:  # every round lowers a label or ends it; log^2 rounds at most
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = checkpointed(large)
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        e = checkpointed(small)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    heads = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
