"""Comparing the members of buckets without emitting the pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block of a bucket has about this many members; more come only if the table is so large that
#: blocks of this size would make more than MOST_HOT hot buckets.
BLOCK, MOST_HOT = 4096, 65536

#: The distances of the rows of the first array from the rows opposite in the second, which must obey the triangle
#: inequality.  Beyond the threshold a lower bound (above the threshold) will do.
Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Buckets up to so many rows are compared together with others of their size.
FEW = 64
#: Rows of a larger bucket that are compared in one step.
CHUNK = 256


def deal_blocks(rows: DataFrame, homes: DataFrame, n_members: int, salt: Column, block: int = BLOCK) -> DataFrame:
    """Adds ``block`` to ``rows`` of (key, home, ...): a large bucket is compared block by block.

    A member is at home in one block of its bucket and visits the others, so every
    pair of a home row and another row of the bucket meets in exactly one block.
    ``homes`` has a row (key) for each home member.  At most MOST_HOT buckets can hold more
    than ``size`` members, and so the table of them is broadcast.
    """
    size = max(block, 2 * n_members // MOST_HOT)
    hot = homes.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > size).select("key", F.ceil(F.col("__n") / size).cast("int").alias("__blocks"))
    dealt = rows.join(F.broadcast(hot), "key", "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(salt), F.col("__blocks")).cast("int")
    dealt = dealt.withColumn("__own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return dealt.withColumn("home", F.col("home") & (F.col("block") == F.col("__own"))).drop("__blocks", "__own")


def _few(distance: Distance, most: int, starts: np.ndarray, sizes: np.ndarray, home: np.ndarray, ids: np.ndarray, load: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside small buckets: all buckets of a size are compared in one step.

    A pair leaves no link where an earlier member is near both, so what leaves connects all that is near in few links.
    """
    for size in np.unique(sizes).tolist():
        i, j = np.tril_indices(size, -1)
        if not len(i):
            continue
        every = starts[sizes == size]
        step = max(1, (1 << 19) // len(i))
        for lo in range(0, len(every), step):
            at = every[lo : lo + step, None]
            a, b = (at + i).ravel(), (at + j).ravel()
            met = np.flatnonzero((home[a] | home[b]) & (ids[a] != ids[b]))
            close = met[distance(load[a[met]], load[b[met]]) <= most]
            near = np.zeros((len(at), size, size), np.float32)
            near[close // len(i), i[close % len(i)], j[close % len(i)]] = 1
            direct = (near > 0) & (near @ near.transpose(0, 2, 1) == 0)
            bucket, x, y = np.nonzero(direct)
            yield ids[at[bucket, 0] + x], ids[at[bucket, 0] + y]


class _Bucket:
    """Homes of the bucket at hand: leaders, and behind each the homes within the threshold of it.

    What is within the threshold of a leader is linked to it and so to all behind it.  What is
    more than twice as far from it can be near none of them; only in between are they compared one by one.
    """

    def __init__(self, distance: Distance, most: int, width: tuple[int, ...]):
        self.distance, self.most, self.root = distance, most, []
        self.ids, self.load = [], np.empty((0, *width), np.int64)
        self.behind: list[list[tuple[int, np.ndarray]]] = []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def add(self, ids: np.ndarray, load: np.ndarray, home: np.ndarray, out: list[tuple[int, int]]) -> None:
        """Homes come before visitors; each row gets a link to every group of homes that it touches."""
        for lo in range(0, len(ids), CHUNK):
            self._add(ids[lo : lo + CHUNK], load[lo : lo + CHUNK], home[lo : lo + CHUNK], out)

    def _distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Every row of ``a`` from every row of ``b``."""
        out = np.empty((len(a), len(b)), np.int64)
        step = max(1, (1 << 17) // max(1, len(b)))
        for lo in range(0, len(a), step):
            part = a[lo : lo + step]
            out[lo : lo + step] = self.distance(np.repeat(part, len(b), axis=0), np.tile(b, (len(part), *[1] * (b.ndim - 1)))).reshape(len(part), len(b))
        return out

    def _add(self, ids: np.ndarray, load: np.ndarray, home: np.ndarray, out: list[tuple[int, int]]) -> None:
        known = len(self.ids)
        far = self._distances(load, self.load[:known]) if known else np.empty((len(ids), 0), np.int64)
        among = self._distances(load, load[home]) if home.any() else None
        place = np.cumsum(home) - 1
        fresh: list[int] = []  # rows of this chunk that became leaders
        for row in range(len(ids)):
            one = int(ids[row])
            apart = np.concatenate([far[row], among[row, place[fresh]]]) if fresh else far[row]
            met: list[int] = []
            close = -1
            for j in np.flatnonzero(apart <= 2 * self.most).tolist():
                if apart[j] <= self.most:
                    if self.ids[j] != one:
                        out.append((one, self.ids[j]))
                    close = j if close < 0 else close
                    met.append(j)
                elif self.behind[j] and not any(self.find(j) == self.find(k) for k in met):
                    near = self._behind(j, one, load[row])
                    if near >= 0:
                        out.append((one, near))
                        met.append(j)
            for j in met[1:]:
                self.root[self.find(j)] = self.find(met[0])
            if not home[row]:
                continue
            if close >= 0:
                self.behind[close].append((one, load[row].copy()))
                continue
            n = len(self.ids)
            if n == len(self.load):
                self.load = np.concatenate([self.load, np.empty((max(16, n), *load.shape[1:]), np.int64)])
            self.load[n] = load[row]
            self.ids.append(one)
            self.behind.append([])
            self.root.append(self.find(met[0]) if met else n)
            fresh.append(row)

    def _behind(self, j: int, one: int, load: np.ndarray) -> int:
        """A home behind leader ``j`` that is within the threshold, or -1."""
        others = self.behind[j]
        for lo in range(0, len(others), 256):
            part = others[lo : lo + 256]
            for k in np.flatnonzero(self.distance(np.broadcast_to(load, (len(part), *load.shape)), np.stack([x for _, x in part])) <= self.most).tolist():
                if part[k][0] != one:
                    return part[k][0]
        return -1


def spanning_links(rows: DataFrame, distance: Distance, most: int, payload: str, width: int = 0) -> DataFrame:
    """Links ``(src, dst)`` that connect what is within ``most`` by ``distance`` in every (key, block).

    ``rows`` has key, block, home, id and a payload (a long, or an array of
    ``width`` longs).  Small buckets are compared many at a time.  The rows of a block arrive together and sorted, homes
    first; only the homes (a bounded block) are held, and visitors pass by in
    batches.  At most one link leaves for each row and group of homes it joins (in small buckets, for each pair that no earlier member links).
    """
    dealt = rows.select("key", "block", "home", "id", payload).repartition("key", "block").sortWithinPartitions("key", "block", F.col("home").desc())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, None
        shape = (width,) if width else ()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            home = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            ids = batch.column(3).to_numpy(zero_copy_only=False)
            load = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, width) if width else batch.column(4).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
            ends = np.concatenate([starts[1:], [n]])
            edge = (starts == 0) | (ends == n)  # the bucket may go on in another batch
            few = ~edge & (ends - starts <= FEW)
            work = (home[starts] & (ends - starts > FEW)) | edge
            for src, dst in _few(distance, most, starts[few], (ends - starts)[few], home, ids, load):
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])
            out: list[tuple[int, int]] = []
            for a, b in zip(starts[work].tolist(), ends[work].tolist()):
                if at != (key[a], block[a]):
                    at, bucket = (key[a], block[a]), _Bucket(distance, most, shape)
                bucket.add(ids[a:b], load[a:b], home[a:b], out)
            if out:
                src, dst = np.array(out, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return dealt.mapInArrow(compare, "src long, dst long")
