"""Phrases whose words belong together, mined with stripes.

A stripe is a prefix with an associative counter of the words that follow it.  Stripes are counted
in the tasks, dealt by prefix and merged elementwise: the merged stripe of a prefix holds the counts of all its
extensions, that of the empty prefix the words, and the longest extension of a phrase tells whether it is part of another.
Level by level, only those phrases are counted both of whose shorter parts reached the least count, so rare phrases,
which are most, are never shuffled.

Cases: a null text is empty and has no phrases; a null language is ``und``; repeated rows count as often as they come;
an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.llm.words import mix, odd
from attestor.plans.durable import durable

#: Texts are counted in slices of about so many bytes, cut where a piece ends (a piece that is longer is one slice).
SLICE = 8 << 20
#: Bits of the filter of frequent phrases: 16 for each, but no more than this (64 MB; beyond it more phrases pass, and the counts stay exact).
MOST_BITS = 1 << 29
#: The stripe of a prefix that makes up a ``HOT``-th of all words is dealt in ``SEGMENTS`` segments, and so is that of the empty prefix.
HOT, SEGMENTS = 4096, 1024

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAP = _BREAK.copy()
_GAP[[ord(" "), ord("\t")]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FACTORS = odd(31, 8)
#: The counter of a stripe: words (they hold no spaces) joined by spaces, and their counts.
_STRIPES = "lang string, prefix string, segment int, words string, counts array<int>"


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, bounds)`` of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), bounds


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """``(ids, words, fresh)`` for every slice: the words in order as places in ``words``, and where a piece begins."""
    data, bounds = _binary(column)
    lo, end = int(bounds[0]), int(bounds[-1])
    while lo < end:
        hi = lo + SLICE
        if hi >= end:
            hi = end
        else:
            edge = int(bounds[np.searchsorted(bounds, hi)])
            found = np.flatnonzero(_BREAK[data[hi:edge]])
            hi = hi + int(found[0]) if len(found) else edge
        part = _LOWER[data[lo:hi]]
        inside = ~_GAP[part]
        heads = bounds[(bounds >= lo) & (bounds < hi)] - lo
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[heads] = inside[heads]
        at = np.flatnonzero(begins)
        lo = hi
        if not len(at):
            continue
        kind = np.int32 if len(part) < 1 << 30 else np.int64  # running counts are the largest arrays here
        ends = _BREAK[part].astype(kind)
        np.add.at(ends, heads, 1)
        piece = np.cumsum(ends, out=ends)[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = piece[1:] != piece[:-1]
        letters = part[inside]
        offsets = np.append(np.cumsum(inside, dtype=kind, out=ends)[at] - 1, len(letters)).astype(np.int64)
        del part, inside, begins, ends, piece
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        yield coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, fresh


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 7) for w in words.to_pylist()], np.uint64)


def _phrase_hashes(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each phrase, from the hashes of its first, second, ... words."""
    total = np.uint64(xxhash.xxh64_intdigest(lang, 8))
    for factor, column in zip(_FACTORS, hashes):
        total = total + mix(column) * factor
    return mix(total)


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(bits)).astype(np.int64), ((hashes >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _known(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    one, two = _probes(hashes, len(bitmap) * 8)
    return ((bitmap[one >> 3] >> (one & 7).astype(np.uint8)) & (bitmap[two >> 3] >> (two & 7).astype(np.uint8)) & 1) > 0


def frequent_filter(grams: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the phrases (lang, phrase), set bits collected as bytes: MOST_BITS bound what the driver gets."""
    bits = 1 << 16
    while bits < min(16 * count, MOST_BITS):
        bits <<= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            langs = batch.column(0).to_pylist()
            for lang, phrase in zip(langs, batch.column(1).to_pylist()):
                found.append(_phrase_hashes(lang, [np.array([xxhash.xxh64_intdigest(w, 7)], np.uint64) for w in phrase.split(" ")]))
            at = np.unique(np.concatenate(_probes(np.concatenate(found), bits)) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array((1 << (at & 7)).astype(np.int32))], ["place", "bit"])

    table = grams.select("lang", "phrase").mapInArrow(run, "place long, bit int").groupBy("place").agg(F.bit_or("bit").alias("byte")).toArrow()
    bitmap = np.zeros(bits // 8, np.uint8)
    bitmap[table["place"].to_numpy()] = table["byte"].to_numpy().astype(np.uint8)
    return bitmap


def _rows(lang: pa.Array, prefix: pa.Array, segment: np.ndarray, words: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, prefix, pa.array(segment, pa.int32()), words, counts], ["lang", "prefix", "segment", "words", "counts"])


def _stripes(lang: str, ids: np.ndarray, words: pa.Array, fresh: np.ndarray, k: int, bitmap: np.ndarray | None, hot: pa.Array) -> pa.RecordBatch | None:
    """The stripes of the phrases of ``k`` words in a slice, as rows of ``_STRIPES``."""
    n, size = len(ids), len(words)
    hashes = _hashes(words)
    at = np.arange(n - k + 1)
    if k > 1 and n >= k:
        joined = np.ones(n - k + 1, bool)
        for j in range(1, k):
            joined &= ~fresh[j : n - k + 1 + j]
        if k == 2:
            known = _known(_phrase_hashes(lang, [hashes]), bitmap)[ids]
        else:
            spelled = hashes[ids]
            known = _known(_phrase_hashes(lang, [spelled[j : n - k + 2 + j] for j in range(k - 1)]), bitmap)
        at = np.flatnonzero(joined & known[: n - k + 1] & known[1 : n - k + 2])
    if not len(at):
        return None
    key = ids[at]
    for j in range(1, k):
        if j > 1:  # numbers of the prefixes stay below the number of places
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + ids[at + j]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    at = at[first]
    prefix = key[first] // size if k > 1 else np.zeros(len(first), np.int64)
    spell = lambda places: words.take(pa.array(ids[places])).cast(pa.large_string()).cast(pa.string())
    heads = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
    start = pc.binary_join_element_wise(*[spell(at[heads] + j) for j in range(k - 1)], " ") if k > 1 else pa.array([""])
    split = np.repeat(pc.is_in(start, hot).to_numpy(zero_copy_only=False), np.diff(np.append(heads, len(at))))
    segment = np.where(split, (hashes[ids[at + k - 1]] % np.uint64(SEGMENTS)).astype(np.int64), 0)
    order = np.lexsort((segment, prefix))
    at, counts, prefix, segment = at[order], counts[order], prefix[order], segment[order]
    place = np.searchsorted(prefix[heads], prefix)
    heads = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1])))
    bounds = pa.array(np.append(heads, len(at)), pa.int32())
    named = pc.binary_join(pa.ListArray.from_arrays(bounds, spell(at + k - 1)), " ")
    return _rows(pa.array([lang] * len(heads), pa.string()), start.take(pa.array(place[heads])), segment[heads], named, pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int32())))


def _total(lang: str, n: int) -> pa.RecordBatch:
    """The stripe without a prefix: how many words there are."""
    return _rows(pa.array([lang]), pa.array([None], pa.string()), np.zeros(1), pa.array([""]), pa.array([[n]], pa.list_(pa.int32())))


def stripes(texts: DataFrame, k: int, bitmap: np.ndarray | None, hot: dict[str, list[str]]) -> DataFrame:
    """Partial stripes of all phrases of ``k`` words of (lang, text) rows, a row for each prefix and segment in a slice.

    ``hot`` names the prefixes of each language whose stripes are dealt in segments.
    """
    shared = texts.sparkSession.sparkContext.broadcast((bitmap, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        for batch in batches:
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                column = batch.column(1).filter(pc.equal(langs, lang))
                for ids, words, fresh in _slices(column):
                    if k == 1:
                        yield _total(lang, len(ids))
                    found = _stripes(lang, ids, words, fresh, k, bitmap, pa.array(hot.get(lang, []) if k > 1 else [""], pa.string()))
                    if found is not None:
                        yield found

    return texts.mapInArrow(run, _STRIPES)


def merged(partial: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, next, n): the elementwise sums of all stripes, entries of ``least`` and more, and the totals.

    Stripes are dealt once, by prefix and segment; the sums need no further shuffle.
    """
    entries = F.arrays_zip(F.split("words", " ").alias("next"), F.col("counts").alias("n"))
    dealt = partial.repartition("lang", "prefix", "segment").select("lang", "prefix", "segment", F.inline(entries).alias("next", "n"))
    sums = dealt.groupBy("lang", "prefix", "segment", "next").agg(F.sum("n").alias("n"))
    return sums.where((F.col("n") >= least) | F.col("prefix").isNull()).drop("segment")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(phrases, totals)``: (lang, phrase, k, f) of all phrases of 1 to ``longest`` words with ``least`` occurrences, and (lang, n)."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where(F.octet_length("text") > 0)
    levels, bitmap, totals, n, hot = [], None, None, 0, {}
    for k in range(1, longest + 1):
        found = durable(merged(stripes(texts, k, bitmap, hot), least), f"stripes-{k}")
        if k == 1:
            totals = found.where("prefix IS NULL").select("lang", "n")
            n = totals.agg(F.sum("n")).first()[0] or 0
            found = found.where("prefix IS NOT NULL")
        phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")) if k == 1 else F.concat_ws(" ", "prefix", "next")
        grams = found.select("lang", phrase.alias("phrase"), F.lit(k).alias("k"), F.col("n").alias("f"))
        levels.append(grams)
        count = grams.count()
        if not count:
            break
        if k < longest:
            bitmap = frequent_filter(grams, count)
            hot = {}  # a HOT-th of all words each: no more than HOT * k prefixes
            for row in grams.where(F.col("f") * HOT >= n).select("lang", "phrase").toLocalIterator():
                hot.setdefault(row.lang, []).append(row.phrase)
    phrases = levels[0]
    for grams in levels[1:]:
        phrases = phrases.unionByName(grams)
    return phrases, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, share: tuple[int, int] = (80, 100), top: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language.

    A phrase with count a, cut in two parts with counts l and r, scores floor(2000000 a / (l + r)); its worst cut counts, the earlier
    on a tie.  A phrase is dropped if a longer one that holds it has ``share`` of its count or more: the counts of what holds
    it only fall with length, so the phrases with one word more decide.  Sums and products are decimals of 38 digits.
    """
    phrases, totals = frequent_phrases(docs, text, lang, least, longest)
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    candidates = phrases.where("k > 1")
    cuts = candidates.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = cuts.select("lang", "phrase", "k", "a", "cut", F.explode(F.array(F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("cut")).alias("part")), F.struct(F.lit(False).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))).alias("side"))
    counts = phrases.select("lang", F.col("phrase").alias("part"), "f")
    sized = sides.select("lang", "phrase", "a", "cut", "side.left", "side.part").join(counts, ["lang", "part"])
    pairs = sized.groupBy("lang", "phrase", "cut").agg(F.first("a").alias("a"), F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = pairs.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    longer = phrases.where("k > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    tops = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    whole = F.col("longer").isNull() | (wide("longer") * share[1] < wide("a") * share[0])
    rows = scored.join(tops, ["lang", "phrase"], "left").where(whole).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
