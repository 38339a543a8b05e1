"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.llm.buckets import deal_blocks, spanning_links
from attestor.llm.near_copies import near_copy_components
from attestor.operators.graph import connected_components
from attestor.plans.durable import durable, small

THRESHOLD = 3


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats included.

    A-Z count as a-z; words end at the six ASCII white-space characters, which is
    what ``bytes.split`` does.  Fewer words than a shingle make one shingle; no word gives 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip([0, *ends[:-shingle]], ends[shingle - 1 :])]
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = np.array(hashes[lo : lo + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``(key, fp)``: the signed 64-bit fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x, shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("binary").alias("__text")).mapInArrow(run, f"`{key}` long, fp long")


def _pair_masks() -> np.ndarray:
    """For each syndrome s: the 16 flips that lead to code words within distance 2 (the first to the nearest)."""
    masks = np.zeros((32, 16), dtype=np.int64)
    for s in range(1, 32):
        flips = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s and i != s]
        masks[s] = flips
    return masks


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words of the perfect Hamming code [31, 26] within distance 2 of 31-bit values, and which of them count.

    The syndrome of a value is the exclusive or of the positions (1 to 31) of its
    ones.  Syndrome 0 is a code word, 31 bits from which no other lies nearer than 3; otherwise one
    code word lies at distance 1 (column 0) and 15 at distance 2.
    """
    syndrome = np.zeros(len(halves), dtype=np.int64)
    for i in range(1, 32):
        syndrome ^= ((halves >> (i - 1)) & 1) * i
    words = halves[:, None] ^ _pair_masks()[syndrome]
    counts = (syndrome != 0)[:, None] | (np.arange(16) == 0)[None, :]
    return words, counts


def anchor_rows(distinct: DataFrame) -> DataFrame:
    """``(key, home, id)`` for every fingerprint and every anchor that it is replicated to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(every), 8192):
                fps = every[lo : lo + 8192]
                bits = fps.view(np.uint64)
                for half, shift in ((0, np.uint64(0)), (1, np.uint64(32))):
                    words, counts = anchors(((bits >> shift) & np.uint64(0x7FFFFFFF)).astype(np.int64))
                    key = words + (half << 31)
                    home = np.zeros(words.shape, dtype=bool)
                    home[:, 0] = True
                    ids = np.repeat(fps, 16).reshape(-1, 16)
                    yield pa.RecordBatch.from_arrays([pa.array(key[counts]), pa.array(home[counts]), pa.array(ids[counts])], names=["key", "home", "id"])

    return distinct.select("fp").mapInArrow(run, "key long, home boolean, id long")


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ from those opposite."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` that connect all fingerprints within 3 bits of each other.

    Anchor-point covering, one code for each half: two fingerprints within 3 bits
    differ in at most 1 bit on one 32-bit half, so on 31 of its bits.  The anchors are
    the code words of the perfect Hamming code there (covering radius 1).  A
    fingerprint is at home at the one anchor within the radius and is replicated to
    every anchor within radius + 1, at most 16 of the 2 ** 26; so the two meet at the home of
    either, and are compared in full there.
    """
    n = distinct.count()
    rows = anchor_rows(distinct)
    homes = rows.where("home").select("key")
    dealt = deal_blocks(rows, homes, 2 * n, F.col("id")).withColumn("fp", F.col("id"))
    return spanning_links(dealt, bits_apart, THRESHOLD, "fp").distinct()


def simhash_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, fp, component_id)`` for every row of ``docs``.

    Rows with the same fingerprint are one node; nodes within 3 bits are linked;
    ``component_id`` is the least key reachable.  Null and empty texts have fingerprint
    0 and are linked like any other; rows with a null key take part, and name a
    component only where no key is known (then null).  Empty tables give empty results.
    """
    prints = durable(with_fingerprints(docs, text, key), "simhash")
    nodes = durable(prints.groupBy("fp").agg(F.min(key).alias("__least")), "simhash-nodes")
    parts = connected_components(fingerprint_links(nodes))
    grouped = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = grouped.groupBy("component").agg(F.min("__least").alias("component_id"))
    labels = grouped.join(named, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select(key, "fp", "component_id")


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each group of near copies stays: that with the least key.

    Near copies are texts whose five-word shingles have a Jaccard similarity of 0.8 or more.  SimHash
    fingerprints of these shingles that anchor-point covering links propose the closest.  At
    0.8 two 64-bit fingerprints differ in about 10 bits, beyond any radius that anchors
    can cover, so MinHash bands propose the rest; all are verified exactly.
    A row with a null key cannot be named by a decision and stays; rows alike in key
    and text count as one document, of which one row stays.
    """
    found = near_copy_components(docs, text, key, fingerprint_links)
    first = durable(found.where(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("__first")).agg(F.count(F.lit(1)).alias("__rows")), "simhash-first")
    once = docs.join(small(first.where("__rows = 1")), docs[key] == F.col("__first"), "left_semi")
    unnamed = docs.where(F.col(f"`{key}`").isNull())
    repeated = first.where("__rows > 1")
    if repeated.isEmpty():
        return once.unionByName(unnamed)
    again = docs.join(repeated, docs[key] == F.col("__first"), "left_semi")
    numbered = again.withColumn("__copy", F.row_number().over(W.partitionBy(key, text).orderBy(key)))
    return once.unionByName(numbered.where("__copy = 1").drop("__copy")).unionByName(unnamed)
