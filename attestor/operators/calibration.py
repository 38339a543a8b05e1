"""How well scores tell what belongs together: pair scores counted by blocks, ranks without a global sort, stable labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.plans.durable import checkpointed, durable

#: Bins that distinct scores are dealt to, by rank.
BINS = 256


def pair_scores(queries: DataFrame, base: DataFrame, key: str, vector: str, label: str, digits: int = 4, block_rows: int = 4096) -> DataFrame:
    """``(score, same, n)``: how many pairs of a query and another row have a rounded cosine, by whether their labels agree.

    Rows are dealt to blocks, counted first; every block of queries meets every block of rows in one task, which counts its pairs and
    leaves a row for each score it saw.  Rows with a null vector, label or component take no part; neither does a vector without length, as it has no angle.
    """
    sound = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(vector, lambda x: x != 0)
    one, two = (df.where(sound).select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")) for df in (queries, base))
    down, across = (max(1, -(-df.count() // block_rows)) for df in (one, two))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = one.withColumn("i", deal(down)).withColumn("j", every(across)).groupBy("i", "j")
    right = two.withColumn("j", deal(across)).withColumn("i", every(down)).groupBy("i", "j")

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"score": [], "same": [], "n": []})
        x, y = (np.stack(p.v.to_numpy()) for p in (a, b))
        long_x, long_y = (np.sqrt((m * m).sum(axis=1)) for m in (x, y))
        parts = []
        for lo in range(0, len(x), 256):  # vectors of whole numbers have exact products
            cosine = (x[lo : lo + 256] @ y.T) / (long_x[lo : lo + 256, None] * long_y[None])
            score = np.floor(cosine * 10**digits + 0.5) / 10**digits + 0.0
            other = a.id.to_numpy()[lo : lo + 256, None] != b.id.to_numpy()[None]
            same = a.label.to_numpy()[lo : lo + 256, None] == b.label.to_numpy()[None]
            parts.append(pd.DataFrame({"score": score[other], "same": same[other], "n": 1}).groupby(["score", "same"], as_index=False).n.sum())
        return pd.concat(parts).groupby(["score", "same"], as_index=False).n.sum()

    return left.cogroup(right).applyInPandas(block, "score double, same boolean, n long").groupBy("score", "same").agg(F.sum("n").alias("n"))


def threshold_curve(scores: DataFrame, score: str = "score", same: str = "same", n: Column | None = None) -> DataFrame:
    """``(threshold, n, precision, recall, auc)`` for every score that occurs: what lies at or above it, and the area under the ROC curve of all.

    Equal scores are one row first.  Distinct scores are dealt by rank to bins; totals of the bins are summed in order, scores only within their bin, so that
    nothing is sorted whole.  A tie counts half in the area; without rows of either kind recall or the area is null.
    """
    weight = F.lit(1) if n is None else n
    told = scores.where(F.col(score).isNotNull() & F.col(same).isNotNull())
    each = durable(told.groupBy(F.col(score).alias("t")).agg(F.sum(F.when(F.col(same), weight).otherwise(0)).cast("long").alias("p"), F.sum(F.when(~F.col(same), weight).otherwise(0)).cast("long").alias("q")), "scores")
    edges = each.agg(F.percentile_approx("t", [i / BINS for i in range(1, BINS)], 10 * BINS).alias("edges"))
    binned = each.join(F.broadcast(edges), F.lit(True)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("t")))).drop("edges")
    sums = binned.groupBy("bin").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq"))
    before = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # BINS rows at most
    lower = sums.select("bin", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("lp"), F.coalesce(F.sum("bq").over(before), F.lit(0)).alias("lq"), F.sum("bp").over(W.partitionBy()).alias("all_p"), F.sum("bq").over(W.partitionBy()).alias("all_q"))
    inside = W.partitionBy("bin").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    below = lambda c: F.col(f"l{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
    rows = durable(binned.join(F.broadcast(lower), "bin").select("t", "p", "q", below("p").alias("p_below"), below("q").alias("q_below"), "all_p", "all_q"), "ranked")
    area = rows.agg((F.sum(F.col("p").cast("double") * (F.col("q_below") + F.col("q") / 2)) / F.nullif(F.max("all_p").cast("double") * F.max("all_q"), F.lit(0.0))).alias("auc"))
    hit, above = F.col("all_p") - F.col("p_below"), F.col("all_p") + F.col("all_q") - F.col("p_below") - F.col("q_below")
    return rows.join(F.broadcast(area), F.lit(True)).select(F.col("t").alias("threshold"), above.alias("n"), (hit / above).alias("precision"), (hit / F.nullif("all_p", F.lit(0))).alias("recall"), "auc")


def align_labels(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """``(new, old, n)``: the label each new cluster keeps, and how many members it shares with it.

    Best overlaps first (then the lesser new, then the lesser old label), each label once: in every round all pairs that are best for
    both their sides are taken, which is what taking one pair after the other would do.  New clusters that are left take the least numbers not in use, with
    n = 0, in their order.  Members with a null cluster or key do not count.
    """
    left, right = (df.select(F.col(key).alias("k"), F.col("cluster").alias(name)).where(f"k IS NOT NULL AND {name} IS NOT NULL") for df, name in ((new, "new"), (old, "old")))
    shared = checkpointed(left.join(right, "k").groupBy("new", "old").agg(F.count(F.lit(1)).alias("n")))
    taken = shared.limit(0)
    order = [F.desc("n"), F.col("new"), F.col("old")]
    while not shared.isEmpty():
        ranked = shared.withColumn("r1", F.row_number().over(W.partitionBy("new").orderBy(*order))).withColumn("r2", F.row_number().over(W.partitionBy("old").orderBy(*order)))
        best = checkpointed(ranked.where("r1 = 1 AND r2 = 1").select("new", "old", "n"))
        taken = checkpointed(taken.unionByName(best))
        shared = checkpointed(shared.join(best.select("new"), "new", "left_anti").join(best.select("old"), "old", "left_anti").select("new", "old", "n"))
    rest = left.select("new").distinct().join(taken.select("new"), "new", "left_anti")
    in_line = rest.withColumn("place", F.row_number().over(W.orderBy("new")))  # clusters, of which there are few
    numbers = taken.sparkSession.range(taken.count() + rest.count()).select(F.col("id").alias("old")).join(taken.select(F.col("old").cast("long")), "old", "left_anti")
    free = numbers.withColumn("place", F.row_number().over(W.orderBy("old")))
    return taken.unionByName(in_line.join(free, "place").select("new", F.col("old").cast(dict(taken.dtypes)["old"]).alias("old"), F.lit(0).cast("long").alias("n")))
