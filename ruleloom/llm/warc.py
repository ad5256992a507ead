"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with a group of whole WARC/1.1
records, and a skippable frame with the seek table of the public seekable format:
compressed and decompressed size of every frame, their number and the magic
number 0x8F92EAB1.  An index maps a record's identifier to its frame and its
offset in the decompressed frame, so one record costs one frame.

Equal payloads of at least ``min_revisit`` bytes are stored once: the row with
the largest key is the ``response``, the others are ``revisit`` records (profile
identical-payload-digest) that name it.  The largest key of a digest is found by
a grouped aggregate of narrow rows and joined back, so a payload that many rows
share never meets in one task.

Bundles lie below ``spark.checkpoint.dir``; a task writes under a temporary name
and renames, and the index names the attempt that counts.

Defined cases: a null payload is empty; payloads under ``min_revisit`` bytes are always
responses; rows with equal keys are all kept, and those that also hold the largest
key of their payload are all responses; null keys never are a response that others
name; keys and URLs may hold any character (headers have them percent-encoded, the index
as they are); an empty table writes no bundle.  A frame holds one record at least, so its
size stays below the seek table's 4 GiB, as a string's does.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, open_fs, shared_dir, small_batches, staged

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def record(identifier: str, url: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One WARC record; a revisit carries no payload."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8"]
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """The headers and the payload of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return head, data[stop + 4 : stop + 4 + int(head["Content-Length"])]


class BundleWriter:
    """Records in, frames out; ``close`` appends the seek table."""

    def __init__(self, sink, *, frame_bytes: int = 256 << 10, level: int = 3):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.open: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame of the record and its offset there."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self._flush()
        place = len(self.frames), self.size
        self.open.append(data)
        self.size += len(data)
        return place

    def _flush(self) -> None:
        packed = self.compressor.compress(b"".join(self.open))
        self.sink.write(packed)
        self.frames.append((len(packed), self.size))
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)


class Bundle:
    """Random access by frame."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames = [struct.unpack_from("<II", table, 8 * i) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.frames:
            self.starts.append(self.starts[-1] + packed)
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            packed, size = self.frames[i]
            self.last = i, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[i]), max_output_size=size)
        return self.last[1]

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)

    def close(self) -> None:
        self.file.close()


_NAME = "urn:ruleloom:page:"


def _identifier(key) -> str:
    """Any key as one header word: what isn't a letter, digit or ``_.-~`` is percent-encoded."""
    return _NAME + ("" if key is None else quote(str(key), safe=""))


def _key(identifier: str) -> str:
    return unquote(identifier.removeprefix(_NAME))


def _uri(url: str) -> str:
    """A URL as one header word: white space, controls and other characters that URLs can't hold are percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="replace")


def write_archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 1000) -> DataFrame:
    """Writes the bundles; returns the index ``key, url, uri, frame, offset``."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = shared_dir(spark)
    kind = pages.schema[key].dataType.simpleString()
    base = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.when(F.octet_length("payload") >= min_revisit, F.sha1(F.col("payload").cast("binary"))))
    narrow = base.select("key", "digest").where("digest is not null")
    narrow = staged(narrow, "digests")
    shared = narrow.groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # Narrow rows: of a digest that many rows share, adaptive execution splits the row side.
    refers = narrow.join(shared, "digest").where("key is null or key <> first").groupBy("key", "digest").agg(F.min("first").alias("first"))
    rows = base.join(refers, base["key"].eqNullSafe(refers["key"]) & base["digest"].eqNullSafe(refers["digest"]), "left").select(base["key"], "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        out = []
        for batch in batches:
            for part in chunks(batch, 2):
                if writer is None:
                    fs, path = open_fs(uri)
                    fs.create_dir(os.path.dirname(path), recursive=True)
                    sink = fs.open_output_stream(f"{path}.writing")
                    writer = BundleWriter(sink)
                places = []
                for k, u, text, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    body = text.encode("utf-8", "surrogatepass")
                    places.append(writer.add(record(_identifier(k), u, body, hashlib.sha1(body).hexdigest(), None if first is None or len(body) < min_revisit else _identifier(first))))
                out.append((part.column(0), part.column(1), places))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(f"{path}.writing", path)
            for keys, urls, places in out:
                yield pa.RecordBatch.from_arrays([keys, urls, pa.array([uri] * len(places), pa.string()), pa.array([p[0] for p in places], pa.int32()), pa.array([p[1] for p in places], pa.int64())], names=["key", "url", "uri", "frame", "offset"])

    return staged(rows.mapInArrow(write, f"key {kind}, url string, uri string, frame int, offset long"), "index").withColumnRenamed("key", key)


def read_archive(index: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Records read back: ``key, payload_bytes, payload_digest, record_type, refers_to``.

    A response's length and digest come from its stored payload (a digest that
    differs from its header is an error), a revisit's from its headers.
    """
    kind = index.schema[key].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, now = None, None
        for batch in batches:
            sizes, digests, types, refers = [], [], [], []
            for uri, frame, offset in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if uri != now:
                    if bundle:
                        bundle.close()
                    bundle, now = Bundle(uri), uri
                head, body = bundle.record(frame, offset)
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response":
                    if hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{uri}: the payload's digest differs from its header")
                    sizes.append(len(body))
                else:
                    sizes.append(int(head["X-Payload-Length"]))
                digests.append(digest)
                types.append(head["WARC-Type"])
                refers.append(_key(head["WARC-Refers-To"][1:-1]) if "WARC-Refers-To" in head else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(types, pa.string()), pa.array(refers, pa.string())], names=["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if bundle:
            bundle.close()

    rows = index.select(F.col(key).alias("key"), "uri", "frame", "offset").mapInArrow(read, f"key {kind.simpleString()}, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.select(F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def oracle() -> str:
    """DuckDB SQL for the rows of ``read_archive`` over pages."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
q AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM q"""
