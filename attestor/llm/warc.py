"""WARC archives: one gzip member for each record, written and read by Spark tasks."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.plans.durable import durable

_CHUNK = 1 << 16
#: So many shared payloads (some 100 bytes each) are broadcast at most.
MOST_BROADCAST = 200_000


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


#: Spark's text writer ends every row with a separator; here that is a gzip member without content.
SEPARATOR = _member(b"", 9)
_ENCODED = SEPARATOR.decode("latin-1")


def record(kind: str, uri: str, payload: bytes | None, headers: list[tuple[str, str]], date: str, digest: str, level: int = 6) -> bytes:
    """One WARC/1.1 record as one gzip member.  Revisits carry no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    body = payload if payload is not None else b""
    block += b"Content-Length: %d\r\n\r\n" % len(body) + body
    name = uuid.uuid5(uuid.NAMESPACE_URL, "\n".join([kind, uri, digest, *(v for _, v in headers)]))
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        *headers,
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return _member(head.encode() + block + b"\r\n\r\n", level)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line_safe(uri: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in uri or "") or "urn:none"


def with_payloads(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, url, payload, digest, bytes)``; a null body is an empty payload."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    sized = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))

    return sized.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("hex", F.sha1("payload"))


def revisit_plan(payloads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(hex, bytes, first)`` for every payload that several pages share: the smallest page_id among them.

    An aggregate with partial results in each task, so one payload with a third of all pages is no matter.
    """
    return payloads.where(F.col("bytes") >= least_bytes).groupBy("hex", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", html: str = "html") -> None:
    """Writes the pages to multi-member gzip files below ``path`` (any file system that Spark writes).

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the smallest
    key is a response and the others revisit it.  Records keep the order of the pages
    inside a file.  Null urls become urn:none; a null key makes a response of its own;
    rows repeated with the same key are all responses.
    """
    payloads = with_payloads(pages, key, html)
    plan = durable(revisit_plan(payloads, least_bytes), "revisits").withColumnRenamed("hex", "__hex").withColumnRenamed("bytes", "__bytes")
    if plan.count() <= MOST_BROADCAST:  # else the payloads are shuffled by their digests
        plan = F.broadcast(plan)
    joined = payloads.join(plan, (F.col("hex") == F.col("__hex")) & (F.col("bytes") == F.col("__bytes")), "left")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    rows = joined.select("page_id", "url", refers.alias("refers_to"), "bytes", "hex", F.when(refers.isNull(), F.col("payload")).alias("payload"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for page, url, refers_to, n, hexed, payload in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    headers = [("X-Page-Id", "" if page is None else str(page)), ("X-Payload-Bytes", str(n))]
                    if refers_to is not None:
                        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
                    digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                    out.append(record("response" if refers_to is None else "revisit", _line_safe(url), payload, headers, date, digest))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = rows.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", _ENCODED).option("encoding", "ISO-8859-1").text(path)


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of a multi-member gzip archive, in order.

    The archive is read in chunks, and members are inflated one after the other, so what is held is one
    record; the block is framed by Content-Length, and its digest is verified.
    Raises ValueError on a broken member, frame or digest.
    """
    ahead = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            chunk = ahead or source.read(_CHUNK)
            if not chunk:
                if parts:
                    raise ValueError("the last gzip member is cut off")
                return
            parts.append(inflate.decompress(chunk))
            ahead = inflate.unused_data
        plain = b"".join(parts)
        if not plain:
            continue
        cut = plain.index(b"\r\n\r\n")
        first, *lines = plain[:cut].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        n = int(fields["Content-Length"])
        block, rest = plain[cut + 4 : cut + 4 + n], plain[cut + 4 + n :]
        if len(block) != n or rest != b"\r\n\r\n":
            raise ValueError("the block does not end where Content-Length says")
        if fields.get("WARC-Block-Digest", f"sha1:{sha1(block)}") != f"sha1:{sha1(block)}":
            raise ValueError("block digest")
        yield fields, block


def read_archive(spark: SparkSession, path: str, with_html: bool = True) -> DataFrame:
    """Every record below ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for fields, block in read_records(pa.BufferReader(content.as_buffer())):
                    payload, kind = block[block.index(b"\r\n\r\n") + 4 :], fields["WARC-Type"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(fields["X-Payload-Bytes"])
                    if kind == "response" and (len(payload) != n or sha1(payload) != digest):
                        raise ValueError("payload digest")
                    page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, fields["WARC-Target-URI"], n, digest, kind, int(refers) if refers else None, payload if with_html and kind == "response" else None))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(parse, schema)


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)
