"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.plans.durable import durable

ROUNDS, SEED = 6, 7919
_WALK = 64


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``row_number`` from 0 in the order of ``order`` and gives the number of rows.

    The rows are range-partitioned and sorted once, and that order is written
    down before it is used twice (for the counts and for the numbers).  Only one
    number for each partition comes together; rows that tie on all of
    ``order`` are alike in these columns and get consecutive numbers.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    here = F.monotonically_increasing_id()
    placed = durable(ranged.withColumn("__part", F.shiftright(here, 33)).withColumn("__at", F.expr("monotonically_increasing_id() & 8589934591")), "numbered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sorted((r["__part"], r["__n"]) for r in sizes.collect())  # one pair for each partition
    starts, total = [], 0
    for part, n in offsets:
        starts.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(starts or [(0, 0)], "__part long, __start long")
    out = placed.join(F.broadcast(table), "__part").withColumn("row_number", F.col("__start") + F.col("__at"))
    return out.drop("__part", "__at", "__start"), total


def _side(n: int) -> int:
    return max(1, math.isqrt(max(n - 1, 0)) + 1)


def _feistel(x: Column, side: int, seed: int) -> Column:
    """All rounds as one fold over a pair, so that no round is written twice into the plan."""
    pair = F.struct(F.call_function("div", x, F.lit(side)).alias("l"), F.pmod(x, F.lit(side)).cast("long").alias("r"))
    step = lambda p, k: F.struct(
        p["r"].alias("l"),
        F.pmod(p["l"] + F.pmod(F.xxhash64(k, p["r"]), F.lit(side)), F.lit(side)).cast("long").alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(seed), F.lit(seed + ROUNDS - 1)), pair, step, lambda p: p["l"] * side + p["r"])


def permute(row: Column, n: int, seed: int = SEED) -> Column:
    """A keyed permutation of 0 .. n-1 as a Spark expression.

    A Feistel network on pairs below ``side`` (side squared is the least square
    not under n) is applied until the value is below n again.  At most
    side * side - n values lie outside, so the walk ends; beyond 64 steps (a chance
    under 10 to the minus 60 for large n) the expression raises instead of guessing.
    """
    side = _side(n)
    steps = min(side * side - n, _WALK)
    walk = lambda acc, i: F.when((i > 0) & (acc < n), acc).otherwise(_feistel(acc, side, seed))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), row.cast("long"), walk)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))


def permute_one(row: int, n: int, seed: int = SEED) -> int:
    """The same permutation for one row number, for readers that look a row up."""
    side, x = _side(n), row
    while True:
        left, right = divmod(x, side)
        for k in range(seed, seed + ROUNDS):
            h = xxhash.xxh64_intdigest(struct.pack("<q", right), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))
            h -= (h >> 63) << 64
            left, right = right, (left + h % side) % side
        x = left * side + right
        if x < n:
            return x


def locate(row: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    at = permute_one(row, n, seed)
    return at % shards, at // shards


def shard_rows(docs: DataFrame, shards: int, order: list[str], seed: int = SEED) -> DataFrame:
    """Adds ``row_number``, ``shard`` and ``slot``: a reproducible shuffle into shards of equal row counts.

    Law ``rows``: the counts of two shards differ by one at most, and the slots of
    a shard run from 0 without a gap.  Nulls in ``order`` come first; rows alike in
    all of ``order`` share their fate as a set; an empty table gives an empty result.
    """
    numbered, n = number_rows(docs, order)
    at = F.col("__at")
    return numbered.withColumn("__at", permute(F.col("row_number"), max(n, 1), seed)).withColumn("shard", (at % shards).cast("int")).withColumn("slot", F.call_function("div", at, F.lit(shards))).drop("__at")
