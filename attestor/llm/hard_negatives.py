"""Hard negatives by rotated one-bit codes with intervals that no score can leave.

Every vector is rotated (signs and Hadamard steps) and stored as one-bit codes: the signs of the rotated vector,
the signs of what they leave over, and so on, each with its alignment, the inner product of the code vector
and what it stands for, and the length of the rest.  An anchor, in six bit planes, meets a code by popcounts, which gives an estimate
of the inner product; by Cauchy and Schwarz the error is at most the anchor's length times that of the rest, plus the rounding of the
planes.  Candidates are those whose interval reaches what is certain already; they get finer codes, and what survives all of
them is scored in whole numbers.  So the results are exact and the intervals only save work.

Cases: rows with a null label, id or vector, or with a null or non-finite component, take no part; of rows alike in their id the least
(label, vector) does; components beyond 2 ** 28 after scaling count as 2 ** 28 (scores then stay within 64 bits up to 64 of them); a shorter vector ends in zeros;
ties fall to the smaller id; an anchor without positives, or a positive without negatives, has no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.llm.words import mix
from attestor.plans.durable import durable

LEVELS, PLANES = 4, 6
#: Rows of a block, and the least number of blocks that rows are dealt to (so that small tables use a cluster too).
BLOCK, LEAST_BLOCKS = 65536, 24
#: Anchors and rows of a tile, whose intervals are in memory together.
TILE_A, TILE_R, FIRST = 64, 4096, 256
MOST = 1 << 28
_CODED = "id long, label long, v array<int>, codes array<long>, align array<double>, rest array<double>"


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows of a power-of-two length, turned by three rounds of fixed signs and a Hadamard transform."""
    n = x.shape[1]
    for turn in range(3):
        x = x * (1.0 - 2.0 * (mix(np.arange(n, dtype=np.uint64) + np.uint64((turn + 1) << 40)) & np.uint64(1)).astype(np.float64))
        half = 1
        while half < n:
            y = x.reshape(len(x), -1, 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            half *= 2
        x = x / np.sqrt(n)
    return x


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def encode(v: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, align, rest)`` of rows: (rows, levels, words), (rows, levels), (rows, levels)."""
    x = rotate(v.astype(np.float64))
    root = np.sqrt(x.shape[1])
    codes, align, rest = [], [], []
    for _ in range(levels):
        up = x >= 0
        a = np.abs(x).sum(axis=1) / root
        x = x - np.where(up, 1.0, -1.0) * (a / root)[:, None]
        codes.append(_packed(up))
        align.append(a)
        rest.append(np.linalg.norm(x, axis=1))
    return np.stack(codes, 1), np.stack(align, 1), np.stack(rest, 1)


def _common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many bits are set in both, over the words of the last axis."""
    out = np.bitwise_count(one[..., 0] & two[..., 0]).astype(np.int32)
    for w in range(1, one.shape[-1]):
        out += np.bitwise_count(one[..., w] & two[..., w])
    return out


class _Block:
    """Rows of a block and the anchors that meet them, both in the order of their labels."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        anchors, rows = anchors.sort_by("label"), rows.sort_by("label")
        self.table = anchors
        self.a_id, self.a_label, self.a_v = _columns(anchors)
        self.id, self.label, self.v = _columns(rows)
        n = len(self.id)
        flat = lambda name: np.array(rows[name].combine_chunks().flatten()).reshape(n, LEVELS, -1)
        self.codes = flat("codes").view(np.uint64)
        self.align, self.rest = flat("align")[:, :, 0], flat("rest")[:, :, 0]
        self.ones = np.stack([_common(self.codes[:, k], self.codes[:, k]) for k in range(LEVELS)], 1)
        self.reach = np.cumsum(self.align, axis=1)
        # anchors as bit planes of their rotated vectors: low + step * (plane 0 + 2 plane 1 + ...), and what that leaves over
        x = rotate(self.a_v.astype(np.float64))
        self.root, self.length, self.low = np.sqrt(x.shape[1]), np.linalg.norm(x, axis=1), x.min(axis=1)
        self.step = (x.max(axis=1) - self.low) / ((1 << PLANES) - 1)
        u = np.rint((x - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.int64)
        known = self.low[:, None] + self.step[:, None] * u
        self.off, self.whole = np.abs(x - known).sum(axis=1) / self.root, known.sum(axis=1)
        self.planes = [_packed((u >> b) & 1) for b in range(PLANES)]

    def tiles(self, same_label: bool) -> Iterator[tuple[slice, slice]]:
        """Anchors and rows that meet: those of one label, or all.  A few rows come first, so that there are scores to beat."""
        if same_label:
            edges = lambda x: np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)).tolist()
            mine, theirs = edges(self.a_label), edges(self.label)
            rows = {int(self.label[lo]): (lo, hi) for lo, hi in zip(theirs, theirs[1:])}
            parts = [(lo, hi, *rows[int(self.a_label[lo])]) for lo, hi in zip(mine, mine[1:]) if int(self.a_label[lo]) in rows]
        else:
            parts = [(0, len(self.a_id), 0, len(self.id))]
        for a_lo, a_hi, r_lo, r_hi in parts:
            for i in range(a_lo, a_hi, TILE_A):
                j, size = r_lo, FIRST
                while j < r_hi:
                    yield slice(i, min(i + TILE_A, a_hi)), slice(j, min(j + size, r_hi))
                    j, size = j + size, TILE_R

    def meet(self, i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
        """Inner products of anchors and unit code vectors, i and j broadcast."""
        codes = self.codes[j, level]
        total = _common(self.planes[0][i], codes)
        for b in range(1, PLANES):
            total += _common(self.planes[b][i], codes) << b
        return (2 * (self.low[i] * self.ones[j, level] + self.step[i] * total) - self.whole[i]) / self.root

    def width(self, i: np.ndarray, j: np.ndarray, level: int, met: np.ndarray | None = None) -> np.ndarray:
        """How far a score can be from its estimate by the codes up to ``level``.

        The rest after the first code is at right angles to it, so that only what the anchor has beside the code counts there.
        """
        length = self.length[i]
        if met is not None:
            length = np.sqrt(np.maximum(length**2 - np.maximum(np.abs(met) - self.off[i], 0) ** 2, 0))
        slack = 1e-9 * (1 + self.length[i] * (self.reach[j, -1] + self.rest[j, 0]))  # room for the rounding of doubles
        return self.reach[j, level] * self.off[i] + self.rest[j, level] * length + slack

    def score(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for lo in range(0, len(i), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            out[at] = np.einsum("ij,ij->i", self.a_v[i[at]], self.v[j[at]])
        return out

    def narrowed(self, a: slice, r: slice, allowed: np.ndarray, need) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(i, j, score)`` of the pairs of a tile whose intervals still matter after all codes.

        ``need(i, low, high)`` tells which do.  While most of a tile is left it is compared whole, then pair by pair.
        """
        i, j = np.arange(a.start, a.stop)[:, None], np.arange(r.start, r.stop)[None]
        estimate, level = 0.0, 0
        while level < LEVELS:
            met = self.meet(i, j, level)
            estimate = estimate + met * self.align[j, level]
            wide = self.width(i, j, level, met if level == 0 else None)
            level += 1
            allowed = allowed & need(i, estimate - wide, estimate + wide)
            if np.count_nonzero(allowed) < 0.2 * allowed.size:
                break
        x, y = np.nonzero(allowed)
        i, j, estimate = x + a.start, y + r.start, estimate[x, y]
        while level < LEVELS and len(i):
            estimate = estimate + self.meet(i, j, level) * self.align[j, level]
            wide = self.width(i, j, level)
            level += 1
            left = np.flatnonzero(need(i, estimate - wide, estimate + wide))
            i, j, estimate = i[left], j[left], estimate[left]
        return i, j, self.score(i, j)


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.array(table["v"].combine_chunks().flatten(), np.int64)
    return table["id"].to_numpy(), table["label"].to_numpy(), v.reshape(table.num_rows, -1)


def _best(group: np.ndarray, score: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each group, by score descending and id."""
    order = np.lexsort((who, -score, group))
    group, score, who = group[order], score[order], who[order]
    place = np.arange(len(group)) - np.searchsorted(group, group)
    keep = place < k
    return group[keep], score[keep], who[keep]


def _raise_floor(floor: np.ndarray, group: np.ndarray, score: np.ndarray, k: int) -> None:
    """Where a group has k scores, only that of the last and better ones matter any more."""
    full = np.flatnonzero(np.bincount(group, minlength=len(floor)) == k)
    floor[full] = score[np.searchsorted(group, full, "right") - 1]


def _nearest(k: int):
    """Of every anchor, the k best rows of its label in the block."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return pa.table({"anchor_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        b = _Block(anchors, rows)
        group, score, who = (np.empty(0, np.int64) for _ in range(3))
        floor = np.full(len(b.a_id), -np.inf)
        for a, r in b.tiles(True):
            i, j, s = b.narrowed(a, r, b.a_id[a, None] != b.id[r], lambda i, low, high: high >= floor[i])
            group, score, who = _best(np.append(group, i), np.append(score, s), np.append(who, b.id[j]), k)
            _raise_floor(floor, group, score, k)
        return pa.table({"anchor_id": b.a_id[group], "id": who, "score": score})

    return run


def _between(k: int, slots: int, low_share: tuple[int, int], high_share: tuple[int, int]):
    """Of every anchor and positive, the k best rows of other labels whose score lies between the shares of the positive's."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "slot": [], "id": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            b = _Block(anchors, rows)
            lows, highs = np.full((slots, len(b.a_id)), np.inf), np.full((slots, len(b.a_id)), -np.inf)
            for i, scores in enumerate(b.table["scores"].to_pylist()):
                for s, p in enumerate(scores):  # whole numbers: the first and the last score allowed
                    lows[s, i], highs[s, i] = -(-low_share[0] * p // low_share[1]), high_share[0] * p // high_share[1]
            floors = lows.copy()
            kept = [tuple(np.empty(0, np.int64) for _ in range(3)) for _ in range(slots)]

            def need(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                some = np.zeros(low.shape, bool)
                for s in range(slots):
                    some |= (high >= floors[s, i]) & (low <= highs[s, i])
                return some

            for a, r in b.tiles(False):
                i, j, score = b.narrowed(a, r, b.a_label[a, None] != b.label[r], need)
                for s in range(slots):
                    fit = (score >= floors[s, i]) & (score <= highs[s, i])
                    if fit.any():
                        g, sc, who = kept[s]
                        kept[s] = _best(np.append(g, i[fit]), np.append(sc, score[fit]), np.append(who, b.id[j[fit]]), k)
                        _raise_floor(floors[s], kept[s][0], kept[s][1], k)
            for s, (g, sc, who) in enumerate(kept):
                for name, x in zip(out, (b.a_id[g], np.full(len(g), s), who, sc)):
                    out[name].append(x)
        return pa.table({name: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for name, x in out.items()})

    return run


def coded_vectors(rows: DataFrame, key: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """The rows that take part, as (id, label, v, codes, align, rest), written down."""
    x = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound)
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    one = durable(x.select("id", F.struct("label", whole.alias("v")).alias("row")).groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v"), "vectors")
    longest = one.agg(F.max(F.size("v"))).first()[0] or 1
    width = 64
    while width < longest:
        width *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.array(lists.value_lengths(), np.int64)
            v = np.zeros((len(lists), width), np.int64)
            v[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.array(lists.flatten(), np.int64)
            codes, align, rest = encode(v)
            lists = lambda m, kind: pa.FixedSizeListArray.from_arrays(pa.array(m.reshape(-1), kind), m.reshape(len(v), -1).shape[1]).cast(pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(v.astype(np.int32), pa.int32()), lists(codes.view(np.int64), pa.int64()), lists(align, pa.float64()), lists(rest, pa.float64())], ["id", "label", "v", "codes", "align", "rest"])

    return durable(one.mapInArrow(run, _CODED), "codes")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: int = 256,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on ``id`` and ``label``.  Anchors and rows are dealt to blocks, counted first, and every block of
    anchors meets every block of rows in one task that holds just these two; a task leaves the best of its block.
    """
    coded = coded_vectors(rows, key, label, vector, scale)
    chosen = coded.where(is_anchor)
    n_rows, n_anchors = coded.count(), chosen.count()
    across, down = max(LEAST_BLOCKS, -(-n_rows // BLOCK)), max(1, -(-n_anchors // BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = coded.withColumn("j", deal(across)).withColumn("i", every(down)).groupBy("i", "j")
    asking = chosen.select("id", "label", "v", deal(down).alias("i"))
    near = asking.withColumn("j", every(across)).groupBy("i", "j").cogroup(spread).applyInArrow(_nearest(positives), "anchor_id long, id long, score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = durable(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    slots = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    probing = asking.toDF(*asking.columns).join(slots.withColumnRenamed("anchor_id", "id"), "id").withColumn("j", every(across)).groupBy("i", "j")
    found = probing.cogroup(spread).applyInArrow(_between(negatives, positives, low, high), "anchor_id long, slot long, id long, score long")
    order = W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    told = near.select("anchor_id", (F.col("place") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.select("anchor_id", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(told, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
