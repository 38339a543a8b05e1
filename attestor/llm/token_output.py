"""Token ids of documents in range-coded, checksummed block files."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import rangecoder
from attestor.plans.durable import durable

END_ID = 2
#: Ids in a block, and blocks coded side by side.
BLOCK, LANES = 1024, 4096
#: Stands between blocks; a reader that lost its place can look for it.
SYNC = b"\xf5\xf7sync\xf7\xf5"
_MAGIC = b"ATB2"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, block size, vocabulary, bytes of the index, bytes of the payload, crc32
_NULL = -(1 << 63)
_MEMO: dict[str, Tokens] = {}


#: Signs that may stand behind a word; the pre-tokenizer below cuts there (not before an apostrophe, which may open an ending).
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
#: What a tokenizer must do to a text for words to go to its model directly.
_NORMALIZER = ["NFC", ("Replace", {"Regex": r"\s+"}, " "), "Lowercase"]
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: How bytes stand in a byte-level vocabulary, as Latin-1 characters.
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


def _is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _cuts_words(tokenizer) -> bool:
    """Whether lower-case words stand alone: NFC and lower case, letters apart from signs, then bytes."""
    form = json.loads(tokenizer.to_str())
    steps = [(n["type"], n.get("pattern"), n.get("content")) if n["type"] == "Replace" else n["type"] for n in (form["normalizer"] or {}).get("normalizers", [])]
    pre = [(p["type"], p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in (form["pre_tokenizer"] or {}).get("pretokenizers", [])]
    alone = all(t["special"] and t["content"].startswith("<|") and not t["normalized"] for t in form["added_tokens"])
    return alone and form["model"]["type"] == "BPE" and steps == _NORMALIZER and pre == [("Split", {"Regex": _CUTS}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]


class Tokens(dict):
    """Ids of texts by a tokenizer file; as a dictionary, the little-endian 16-bit ids of white-space-free chunks.

    The vocabularies' pre-tokenizers never join text across white space, so the
    ids of a text are those of its chunks in order.  Chunks are cut at the six ASCII
    white-space characters only; anything else is left to the tokenizer.  A text with a
    special token's brackets goes to the tokenizer whole.

    Where the tokenizer cuts words by ``_CUTS``, a word of lower-case Latin-1 letters is a piece of
    its own, which its model takes without the steps before, and ``_SIGNS`` behind it are
    others; texts of Latin-1 characters, which NFC leaves alone, are put in lower case first.

    ``most`` chunks are remembered, in two halves: those looked up since the last turn, and those of the turn before.
    """

    #: Longer chunks are not remembered.
    LONG = 100

    def __init__(self, path: str, most: int = 800_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if self.vocab > 65536:
            raise ValueError("ids must fit 16 bits")
        self.model = self.tokenizer.model if _cuts_words(self.tokenizer) else None
        self.bytes_of = [struct.pack("<H", i) for i in range(self.vocab)]
        self.half, self.old = most // 2, {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _work_out(self, chunk: bytes) -> bytes:
        if self.model is None:
            return self._ids(chunk.decode())
        word = chunk.rstrip(_SIGNS)
        if word.isalpha() and word.islower():  # ASCII letters only
            if len(word) < len(chunk):
                return self[word] + self[chunk[len(word) :]]
            return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(word.decode())])
        text = chunk.decode()
        if not _is_latin(text):
            return self._ids(text)
        if (low := text.lower()) != text:
            return self[low.encode()]
        if word.decode().isalpha():
            if len(word) < len(chunk):
                return self[word] + self[chunk[len(word) :]]
            return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(word.decode("latin-1").translate(_BYTES))])
        return self._ids(text)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._work_out(chunk)
        if len(chunk) <= self.LONG:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Little-endian 16-bit ids of each text."""
        get = self.__getitem__
        for text in texts:
            text = text or b""
            if b"<|" in text:
                yield self._ids(text.decode())
                continue
            if self.model is not None:
                if text.isascii():
                    text = text.lower()
                elif _is_latin(plain := text.decode()):
                    text = plain.lower().encode()
            yield b"".join(map(get, text.split()))


def _tokens(path: str) -> Tokens:
    if path not in _MEMO:
        _MEMO.clear()
        _MEMO[path] = Tokens(path)
    return _MEMO[path]


class _Stream:
    """Ids of consecutive documents, cut into blocks when enough have gathered."""

    def __init__(self, vocab: int, block: int, lanes: int):
        self.vocab, self.block, self.enough = vocab, block, block * lanes
        self.parts: list[bytes] = []
        self.n, self.begins = 0, []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.begins.append((_NULL if doc is None else doc, self.n))
        self.parts.append(ids)
        self.n += len(ids) // 2

    def blocks(self, final: bool) -> Iterator[bytes]:
        while self.n >= self.enough or (final and self.n):
            ids = np.frombuffer(b"".join(self.parts), dtype="<u2")
            take = min(self.enough, len(ids))
            # few ids make shorter blocks, so that some hundred are coded side by side
            size = self.block if take == self.enough else max(256, min(self.block, 1 << (take // 512).bit_length()))
            coded = rangecoder.encode(ids[:take], size, self.vocab)
            starts = np.array([s for _, s in self.begins], dtype=np.int64)
            for i, payload in enumerate(coded):
                a, b = i * size, min((i + 1) * size, take)
                lo, hi = np.searchsorted(starts, [a, b])
                table = np.array([(d, s - a) for d, s in self.begins[lo:hi]], dtype="<i8").reshape(-1, 2)
                index = zlib.compress(table.T.tobytes(), 6) if len(table) else b""
                rest = _HEAD.pack(_MAGIC, b - a, size, self.vocab, len(index), len(payload), 0)[4:-4] + index + payload
                yield _MAGIC + rest[: _HEAD.size - 8] + struct.pack("<I", zlib.crc32(rest)) + rest[_HEAD.size - 8 :]
            self.parts = [ids[take:].tobytes()]
            self.n -= take
            done = int(np.searchsorted(starts, take))
            self.begins = [(d, s - take) for d, s in self.begins[done:]]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID, block: int = BLOCK, lanes: int = LANES) -> None:
    """Writes the ids of all documents, each followed by ``end_id``, in ascending order of ``key``.

    Files follow each other by their part numbers, and blocks inside a file; a block
    notes the documents that begin in it, the first of each group of ``lanes`` the frequencies of the group's ids.  Null keys come first, null texts are empty, rows alike in
    key are ordered by a hash of the text.  Spark's text writer carries the blocks to any file
    system, with SYNC as its line separator.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("binary").alias("t"))
    # the range is sampled on the driver, so a hash stands for the text there
    place = [F.col("k").asc_nulls_first(), F.xxhash64("t").asc()]
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place, F.col("t").asc_nulls_first())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer_path)
        stream = _Stream(tokens.vocab, block, lanes)
        end = struct.pack("<H", end_id)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist())):
                    stream.add(doc, ids + end)
                yield from _rows(stream.blocks(False))
        yield from _rows(stream.blocks(True))

    def _rows(blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for b in blocks:
            held.append(b)
            if len(held) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    coded = ordered.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    coded.write.option("lineSep", SYNC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def _parse(data: bytes | memoryview) -> Iterator[tuple[int, int, int, np.ndarray, bytes | memoryview]]:
    data = memoryview(data).cast("B")
    at, mark = 0, len(SYNC)
    while at < len(data):
        magic, n, size, vocab, n_index, n_payload, crc = _HEAD.unpack_from(data, at)
        if magic != _MAGIC:
            raise ValueError("no block where one should begin")
        body = at + _HEAD.size
        end = body + n_index + n_payload
        if zlib.crc32(data[body:end], zlib.crc32(data[at + 4 : at + _HEAD.size - 4])) != crc:
            raise ValueError("block check sum")
        if data[end : end + mark] != SYNC:
            raise ValueError("no sync mark behind a block")
        table = np.frombuffer(zlib.decompress(data[body : body + n_index]), dtype="<i8").reshape(2, -1) if n_index else np.zeros((2, 0), np.int64)
        yield n, size, vocab, table, data[body + n_index : end]
        at = end + mark


def read_ids(data: bytes | memoryview, lanes: int = LANES) -> Iterator[tuple[int | None | bool, np.ndarray]]:
    """``(key, ids)`` pieces of a file in order; where a document goes on in a later group of blocks, the key of that piece is False.

    At most ``lanes`` blocks are decoded side by side; a block with a table of frequencies begins a group.
    """
    group: list[tuple[int, int, int, np.ndarray, bytes]] = []
    table: rangecoder.Table | None = None

    def flush() -> Iterator[tuple[int | None | bool, np.ndarray]]:
        ids = rangecoder.decode([g[4] for g in group], [g[0] for g in group], group[0][1], group[0][2], table)
        offsets = np.concatenate([[0], np.cumsum([g[0] for g in group])])
        docs = np.concatenate([g[3][0] for g in group])
        begins = np.concatenate([g[3][1] + o for g, o in zip(group, offsets)]).astype(np.int64)
        cuts = [*begins.tolist(), len(ids)]
        if cuts[0]:
            yield False, ids[: cuts[0]]
        for i, d in enumerate(docs.tolist()):
            yield (None if d == _NULL else d), ids[cuts[i] : cuts[i + 1]]

    for found in _parse(data):
        first = rangecoder.carries_table(found[4])
        if group and (first or len(group) == lanes or found[1] != group[0][1] or group[-1][0] != group[0][1]):
            yield from flush()
            group = []
        if first:
            table = rangecoder.table_of(found[4], found[2])
        group.append(found)
    if group:
        yield from flush()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files below ``path``.

    ``start`` adds the ids of the files before (one number for each file) to the place in the file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out: list[list] = []
                at = 0
                for doc, ids in read_ids(memoryview(content.as_buffer())):
                    crc = ids.astype("<u4").tobytes()
                    if doc is False:
                        out[-1][2] += len(ids)
                        out[-1][3] = zlib.crc32(crc, out[-1][3])
                    else:
                        out.append([doc, at, len(ids), zlib.crc32(crc)])
                    at += len(ids)
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), *(pa.array(c, pa.int64()) for c in cols)], names=["file", "doc_id", "place", "n_tokens", "ids_crc32"])

    rows = durable(files.mapInArrow(run, "file string, doc_id long, place long, n_tokens long, ids_crc32 long").withColumn("file", F.regexp_extract("file", r"part-(\d+)", 1).cast("int")), "tokens")
    sizes = sorted((r["file"], r["n"]) for r in rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())  # one pair for each file
    starts, total = [], 0
    for file, n in sizes:
        starts.append((file, total))
        total += n
    table = spark.createDataFrame(starts or [(0, 0)], "file int, before long")
    return rows.join(F.broadcast(table), "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
