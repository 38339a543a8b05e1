"""Stories, sides, clusters and timelines: grouped numpy inside one story, relational around it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.operators.graph import connected_components
from attestor.operators.intake import first_by


def story_core(rows: DataFrame, story: str, key: str, at: str, vector: str) -> DataFrame:
    """The most central of the first three rows of a story (by mean cosine to the others; the earlier on a tie)."""
    three = rows.withColumn("__i", F.row_number().over(W.partitionBy(story).orderBy(at, key))).where("__i <= 3")
    a = three.select(story, F.col(key).alias("__a"), "__i", F.col(vector).alias("__x"))
    b = three.select(story, F.col(key).alias("__b"), F.col(vector).alias("__y"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    pairs = a.join(b, story).withColumn("__c", dot(F.col("__x"), F.col("__y")) / F.sqrt(dot(F.col("__x"), F.col("__x")) * dot(F.col("__y"), F.col("__y"))))
    score = pairs.groupBy(story, "__a", "__i").agg(F.round(F.sum("__c"), 9).alias("__s"))
    return first_by(score, [story], [F.desc("__s"), F.col("__i")]).select(story, F.col("__a").alias("core"))


def _near_parts(x: np.ndarray, cut: float, rows: int = 512) -> list[np.ndarray]:
    """Rows of unit vectors in parts that no cosine of ``cut`` or more connects; ``rows`` rows meet all others at a time."""
    left, parts = np.ones(len(x), dtype=bool), []
    while left.any():
        part, todo = [], [int(left.argmax())]
        left[todo] = False
        while todo:
            now, todo = todo[:rows], todo[rows:]
            part += now
            rest = np.flatnonzero(left)
            found = rest[(x[rest] @ x[now].T >= cut - 1e-9).any(axis=1)]
            left[found] = False
            todo += found.tolist()
        parts.append(np.sort(np.array(part)))
    return parts


def average_linkage(x: np.ndarray, cut: float) -> list[list[int]]:
    """Average-linkage groups of the rows of unit vectors at a cosine cut.

    The mean cosine between two groups is the product of their mean vectors, so no matrix of all pairs is held.  Chains of nearest
    neighbours end in two groups that are nearest to each other, which the greedy order would merge as well; a merged group is never nearer to a third than
    its parts were, so a group without a neighbour at the cut is done.  Equal rows are one from the start; rows of zeros stay alone.
    """
    told = np.flatnonzero(x.any(axis=1))
    done = [[int(i)] for i in np.flatnonzero(~x.any(axis=1))]
    mean, of = np.unique(x[told], axis=0, return_inverse=True)
    members = [[] for _ in range(len(mean))]
    for i, g in zip(told.tolist(), of.ravel()):
        members[g].append(i)
    for part in _near_parts(mean, cut):
        m, own = mean[part].copy(), [members[g] for g in part]
        size, bias, chain = np.array([len(g) for g in own], dtype=np.float64), np.zeros(len(part)), []
        alive = len(part)
        while alive:
            if not chain:
                if 2 * alive <= len(m):
                    keep = bias == 0
                    m, size, own = m[keep], size[keep], [g for g, k in zip(own, keep) if k]
                    bias = np.zeros(len(m))
                chain.append(int((bias == 0).argmax()))
            a = chain[-1]
            near = m @ m[a] + bias
            near[a] = -np.inf
            b = int(near.argmax())
            if len(chain) > 1 and near[chain[-2]] >= near[b] - 1e-12:
                b = chain[-2]
            if near[b] < cut:
                done.append(own[chain.pop()])
                bias[a], alive = -np.inf, alive - 1
            elif len(chain) > 1 and b == chain[-2]:
                del chain[-2:]
                m[b] = (m[a] * size[a] + m[b] * size[b]) / (size[a] + size[b])
                size[b] += size[a]
                own[b] = own[b] + own[a]
                bias[a], alive = -np.inf, alive - 1
            else:
                chain.append(b)
    return done


def story_split(rows: DataFrame, story: str, key: str, vector: str, cut: float = 0.72, least: int = 4) -> DataFrame:
    """``(story, key, part)``: average-linkage groups at a cosine cut; part 0 is the largest and keeps the story.

    A story is bounded by its time window; stories below ``least`` rows stay whole.  Memory grows with the rows of a story, not with their square.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        label = np.zeros(len(pdf), dtype=np.int64)
        if len(pdf) >= least:
            x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            groups = sorted(average_linkage(x, cut), key=lambda g: (-len(g), min(g)))
            for part, g in enumerate(groups):
                label[g] = part if len(g) >= 2 or part == 0 else 0
        return pd.DataFrame({story: pdf[story].to_numpy(), key: pdf[key].to_numpy(), "part": label})

    return rows.select(story, key, vector).groupBy(story).applyInPandas(split, f"{story} long, {key} long, part long")


def two_sided(pairs: DataFrame, story: str = "story_id") -> DataFrame:
    """``(story, unit, side)`` by the sign of the extreme eigenvector of the agreement matrix; 0 where the sides are not apart."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        units = sorted(set(pdf.a) | set(pdf.b))
        at = {u: i for i, u in enumerate(units)}
        m = np.zeros((len(units), len(units)))
        for a, b, v in zip(pdf.a, pdf.b, pdf.value):
            m[at[a], at[b]] = m[at[b], at[a]] = v
        value, vector = np.linalg.eigh(m)
        v = vector[:, -1] * np.sign(vector[np.abs(vector[:, -1]).argmax(), -1])
        side = np.where(v >= 0, 1, -1)
        same = side[:, None] == side[None, :]
        off = ~np.eye(len(units), dtype=bool)
        intra, inter = m[same & off], m[~same]
        if not len(inter) or not len(intra) or inter.mean() >= intra.mean() - 0.25:
            side[:] = 0
        return pd.DataFrame({story: pdf[story].iloc[0], "unit": units, "side": side})

    return pairs.select(story, "a", "b", "value").groupBy(story).applyInPandas(split, f"{story} long, unit string, side long")


def timeline_tiers(events: DataFrame, story: str = "story_id", key: str = "canonical_id", start: str = "t_start", end: str = "t_end") -> DataFrame:
    """``(story, key, tier)``: the longest chain of events before each, where a comes before b if it ends before b starts.

    The longest chain that ends before a moment takes the earliest end, then the earliest end among
    what starts after it, and so on.  One pass over the events of a story in order of their ends finds these
    moments, holding the last of them; the tier is how many lie before the start.  Stories are sorted, never gathered.
    Events without a start or an end have no tier (null).
    """
    known = events.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    dated = known.select(F.col(story).alias("s"), F.unix_micros(F.col(start)).alias("a"), F.unix_micros(F.col(end)).alias("b")).repartition("s").sortWithinPartitions("s", "b", "a")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, n = None, 0, 0
        for batch in batches:
            found = []
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if s != at or a > last:
                    at, last, n = s, b, 1 if s != at else n + 1
                    found.append((s, b, n))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["s", "b", "n"])

    chain = dated.mapInArrow(moments, "s long, b long, n long")
    rows = known.select(F.col(story).alias("s"), F.col(key).alias("k"), F.unix_micros(F.col(start)).alias("b"), F.lit(None).cast("long").alias("n")).unionByName(chain.select("s", F.lit(None).cast("long").alias("k"), "b", "n"))
    before = F.max("n").over(W.partitionBy("s").orderBy("b").rangeBetween(W.unboundedPreceding, -1))
    tiers = rows.select("s", "k", "n", F.coalesce(before, F.lit(0)).alias("tier")).where("n IS NULL")
    undated = events.where(F.col(start).isNull() | F.col(end).isNull()).select(F.col(story).alias("s"), F.col(key).alias("k"), F.lit(None).cast("long").alias("tier"))
    return tiers.select("s", "k", "tier").unionByName(undated).select(F.col("s").alias(story), F.col("k").alias(key), F.col("tier"))


def merge_statements(claims: DataFrame, same: DataFrame, apart: DataFrame, statement: str = "canonical_id") -> DataFrame:
    """``claims`` repointed to the best statement of each same-fact group: the most articles, then the longest text, then the least id.

    ``same`` and ``apart`` have pairs (a, b): what is said to be the same fact, and disputes or updates, which are never merged.
    A merged statement is an event if any of its own was.
    """
    either = apart.select("a", "b").unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b")))
    allowed = same.join(either, ["a", "b"], "left_anti")
    groups = connected_components(allowed, "a", "b").withColumnRenamed("node", statement)
    stats = claims.groupBy(statement).agg(F.count_distinct("article_id").alias("__n"), F.max(F.length("text")).alias("__len"))
    placed = stats.join(groups, statement, "left").withColumn("component", F.coalesce("component", statement))
    best = placed.groupBy("component").agg(F.min(F.struct((-F.col("__n")).alias("n"), (-F.col("__len")).alias("l"), F.col(statement).alias("id"))).alias("__best"))
    map_ = placed.join(best, "component").select(statement, F.col("__best.id").alias("__to"))
    moved = claims.join(map_, statement)
    kinds = moved.groupBy("__to").agg(F.max(F.col("kind") == "event").alias("__event"))
    return moved.join(kinds, "__to").select("claim_id", F.col("__to").alias(statement), F.when(F.col("__event"), "event").otherwise(F.col("kind")).alias("kind"))


def snapshot_assign(scores: DataFrame, key: str, story: str, join_at: float, ask_at: float) -> DataFrame:
    """Where each article goes against fixed stories: join, ask or new, by its best mean of two similarities."""
    best = first_by(scores, [key], [F.desc("top2"), F.col(story)])
    action = F.when(F.col("top2") >= join_at, "join").when(F.col("top2") >= ask_at, "ask").otherwise("new")
    return best.select(key, F.when(action != "new", F.col(story)).alias(story), action.alias("action"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    pairs = lambda c: c * (c - 1) / 2
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("x"), F.sum("n").alias("n"))
    one = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("ra"))
    two = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("rb"))
    expected = F.col("ra") * F.col("rb") / pairs(F.col("n"))
    return both.join(F.broadcast(one), F.lit(True)).join(F.broadcast(two), F.lit(True)).select(((F.col("x") - expected) / ((F.col("ra") + F.col("rb")) / 2 - expected)).alias("ari"))


def departures(rows: DataFrame, key: str, own: str, cluster: str, value: str, margin: float = 0.5, least: int = 3) -> DataFrame:
    """Articles whose best other cluster beats their own mean by the margin, with enough evidence."""
    m = rows.groupBy(key, own, cluster).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"))
    mine = m.where(F.col(own) == F.col(cluster)).select(key, F.col("m").alias("mine"))
    other = first_by(m.where((F.col(own) != F.col(cluster)) & (F.col("n") >= least) & (F.col("m") > 0)), [key], [F.desc("m"), F.col(cluster)]).select(key, F.col(cluster).alias("to"), F.col("m").alias("theirs"))
    return other.join(mine, key, "left").where(F.col("theirs") - F.coalesce("mine", F.lit(0.0)) >= margin).select(key, "to")


def spectral_trials(affinity: DataFrame, ks: tuple[int, ...] = (2, 3, 4), rounds: int = 50) -> DataFrame:
    """``(k, unit, cluster, silhouette)``: spectral clustering of a unit-by-unit affinity for every k, one task a trial.

    The table holds pairs of sources (some hundreds of sources), not of documents; missing pairs count 0.5.
    """

    def trial(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.k.iloc[0])
        units = sorted(set(pdf.a) | set(pdf.b))
        at = {u: i for i, u in enumerate(units)}
        m = np.full((len(units), len(units)), 0.5)
        for a, b, v in zip(pdf.a, pdf.b, pdf.affinity):
            m[at[a], at[b]] = m[at[b], at[a]] = v
        np.fill_diagonal(m, 1.0)
        d = 1 / np.sqrt(m.sum(axis=1))
        _, vectors = np.linalg.eigh(d[:, None] * m * d[None, :])
        x = vectors[:, -k:]
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        centres = [x[0]]
        while len(centres) < k:  # farthest first: the same on every run
            centres.append(x[np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0).argmax()])
        centres = np.array(centres)
        for _ in range(rounds):
            label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        score = []
        for i in range(len(units)):
            means = [far[i, (label == c) & (np.arange(len(units)) != i)].mean() if ((label == c) & (np.arange(len(units)) != i)).any() else np.inf for c in range(k)]
            own, other = means[label[i]], min(v for c, v in enumerate(means) if c != label[i])
            score.append(0.0 if not np.isfinite(own) or not np.isfinite(other) else (other - own) / max(own, other, 1e-12))
        return pd.DataFrame({"k": k, "unit": units, "cluster": label.astype("int64"), "silhouette": float(np.mean(score))})

    trials = affinity.select("a", "b", "affinity", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return trials.groupBy("k").applyInPandas(trial, "k long, unit string, cluster long, silhouette double")
