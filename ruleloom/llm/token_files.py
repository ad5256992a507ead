"""Token-ID files: Arrow streams of fixed-size-list batches.

A file is an Arrow IPC stream whose batches have two columns of equal-length
lists: ``ids`` (fixed_size_list<uint16 or uint32>) and ``mask``
(fixed_size_list<bool>, false where the last sequence of a file is filled up).
Files are uncompressed, so a memory-mapped file gives each sequence and mask
without a copy.  Rows are encoded with the tokenizers library, get an end id,
and lie end to end in ascending order of their key; a file holds one range of keys.

Words are what ASCII white space separates.  The tokenizer must not look across
white space (its pre-tokenizer drops it), so each distinct word is encoded by the
library once a process (up to ``_MOST`` remembered words) and its ids are reused.

Files are written below ``spark.checkpoint.dir`` under a temporary name and
renamed, one name for a task attempt; the table of files names the attempt that
counts.  A lost executor's task writes its file again.

Defined cases: null and empty texts are the end id alone; rows with equal keys stay
and follow each other in order of their texts; null keys come first; an empty
table has no file.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, open_fs, shared_dir, staged, text_table

_MOST = 300_000
_SPLIT = re.compile(r"[ \t\r\n]+").split
_KEPT: dict[str, WordEncoder] = {}
#: Words of printable ASCII and Latin-1 letters, and how the pattern of the tokenizer cuts them once in lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PLAIN_TEXT = re.compile(r"[!-~À-ÖØ-öø-ÿ \t\r\n]+").fullmatch
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t\r\n]+").findall
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Texts to ids as little-endian bytes, word by word through the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # Only where the file lower-cases and cuts by just that pattern may words be cut beforehand.
        spec = json.loads(self.library.to_str())
        text = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        self.cuts = json.dumps(_CUTS) in text and '"Lowercase"' in text
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)").search
        suffix = spec["model"].get("end_of_word_suffix")
        self.cuts = self.cuts and bool(suffix)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _KEPT:
            _KEPT[path] = cls(path)
        return _KEPT[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 4096):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return out

    def _pieces(self, new: list[str]) -> list[bytes]:
        """Pieces that are one pre-token each, many to a call: a token that ends a word ends a piece."""
        out: list[bytes] = []
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(stops) == len(part):
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *stops], stops)]
            else:
                out += self._library(part)
        return out

    def _learn(self, new: list[str]) -> None:
        """Adds words; plain ones are cut where the pre-tokenizer cuts them, so that few pieces are new to the library."""
        words, pieces = self.words, self.pieces
        plain = [w for w in new if self.cuts and _PLAIN(w) and not self.special(w)]
        cut = [_CUT(w.lower()) for w in plain]
        fresh = list({p: None for ps in cut for p in ps if p not in pieces})
        pieces.update(zip(fresh, self._pieces(fresh), strict=True))
        for w, ps in zip(plain, cut, strict=True):
            words[w] = b"".join([pieces[p] for p in ps])
        rest = [w for w in new if w not in words]
        words.update(zip(rest, self._library(rest), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > _MOST:
            self.words = {"": b""}
        if len(self.pieces) > 2 * _MOST:
            self.pieces = {}
        words, pieces = self.words, self.pieces
        # Plain texts are cut into pieces at once, others into words first.
        plain = [bool(x) and self.cuts and _PLAIN_TEXT(x) is not None and self.special(x) is None for x in texts]
        split = [_CUT(x.lower()) if ok else _SPLIT(x) if x else [] for x, ok in zip(texts, plain)]
        fresh: set[str] = set()
        for ps, ok in zip(split, plain):
            if ok:
                fresh.update(ps)
        if fresh := sorted(fresh.difference(pieces)):
            pieces.update(zip(fresh, self._pieces(fresh)))
        new = list({w: None for ws, ok in zip(split, plain) if not ok for w in ws if w not in words})
        if new:
            self._learn(new)
        return [b"".join(map((pieces if ok else words).__getitem__, ps)) for ps, ok in zip(split, plain)]


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", kind, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])


def _batch(ids: np.ndarray, real: int, length: int, schema: pa.Schema) -> pa.RecordBatch:
    mask = np.arange(len(ids)) < real
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), type=schema.field("ids").type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=schema.field("mask").type)], schema=schema)


class SequenceWriter:
    """Ids in, equal-length sequences out; ``close`` fills up the last one."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int = 256):
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = _schema(pa.from_numpy_dtype(dtype), length)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.waiting: list[bytes] = []
        self.bytes = self.total = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.bytes += len(ids)
        self.total += len(ids) // self.dtype.itemsize
        if self.bytes >= self.rows * self.length * self.dtype.itemsize:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.dtype)
        block = self.rows * self.length
        at = 0
        while len(ids) - at >= block:
            self.stream.write_batch(_batch(ids[at : at + block], block, self.length, self.schema))
            at += block
        rest = ids[at:]
        if last and len(rest):
            filled = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            filled[: len(rest)] = rest
            self.stream.write_batch(_batch(filled, len(rest), self.length, self.schema))
            rest = rest[:0]
        self.waiting = [rest.tobytes()]
        self.bytes = len(self.waiting[0])

    def close(self) -> int:
        self._write(True)
        self.stream.close()
        return self.total


class SequenceFile:
    """Random access to a file's sequences without copying them."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        from pyarrow.fs import LocalFileSystem

        self.source = pa.memory_map(path) if isinstance(fs, LocalFileSystem) else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.starts = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def _part(self, column: int, i: int) -> pa.Array:
        if not 0 <= i < len(self):
            raise IndexError(i)
        b = int(np.searchsorted(self.starts, i, "right")) - 1
        return self.batches[b].column(column)[i - int(self.starts[b])].values

    def ids(self, i: int) -> np.ndarray:
        return self._part(0, i).to_numpy()

    def mask(self, i: int) -> np.ndarray:
        return self._part(1, i).to_numpy(zero_copy_only=False)

    def stream(self) -> Iterator[np.ndarray]:
        """All real ids, batch by batch."""
        for b in self.batches:
            ids, mask = b.column(0).values.to_numpy(), b.column(1).values
            yield ids[: pa.compute.sum(mask).as_py()] if pa.compute.min(mask).as_py() is False else ids


def write_tokens(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end: int = 1, length: int = 2048, partitions: int | None = None) -> DataFrame:
    """Writes the files; returns ``part, uri, first_n, key, n_tokens``-rows: the documents of each file in order.

    Columns: ``part`` (the file's number in key order), ``at`` (a row's number in the file),
    ``key``, ``n_tokens`` and ``uri``.
    """
    import pyarrow.compute  # noqa: F401

    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    folder = shared_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = text_table(docs, key, text).repartitionByRange(n, "key").sortWithinPartitions("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, writer, out = WordEncoder.of(tokenizer), None, []
        stop = np.array([end], encoder.dtype).tobytes()
        uri = f"{folder}/{part:06d}-{uuid.uuid4().hex}.arrows"
        for batch in batches:
            for piece in chunks(batch):
                if writer is None:
                    fs, path = open_fs(uri)
                    fs.create_dir(os.path.dirname(path), recursive=True)
                    sink = fs.open_output_stream(f"{path}.writing")
                    writer, at = SequenceWriter(sink, encoder.dtype, length), 0
                sizes = []
                for ids in encoder.encode(piece.column(1).to_pylist()):
                    writer.add(ids + stop)
                    sizes.append(len(ids) // encoder.dtype.itemsize + 1)
                out.append((piece.column(0), sizes))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(f"{path}.writing", path)
            for keys, sizes in out:
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(sizes), pa.int32()), pa.array(range(at, at + len(sizes)), pa.int64()), keys, pa.array(sizes, pa.int64()), pa.array([uri] * len(sizes), pa.string())], names=["part", "at", "key", "n_tokens", "uri"])
                at += len(sizes)

    return staged(ordered.mapInArrow(write, f"part int, at long, key {kind}, n_tokens long, uri string"), "files").withColumnRenamed("key", key)


def read_tokens(spark: SparkSession, index: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Documents read back: ``key, start, n_tokens, ids_crc32`` from the files that ``index`` names."""
    files = index.groupBy("part", "uri").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"))
    # One row a file: bounded by the number of tasks that wrote, not by the documents.
    starts, at = [], 0
    for r in files.orderBy("part").collect():
        starts.append((r["part"], r["uri"], at))
        at += r["n"]
    kind = index.schema[key].dataType.simpleString()
    if not starts:
        return spark.createDataFrame([], f"{key} {kind}, start long, n_tokens long, ids_crc32 long")
    table = {part: (uri, start) for part, uri, start in starts}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stream, held, offset = None, iter(()), np.empty(0, np.uint32), 0
        for batch in batches:
            where, crcs, begins = batch.column(0).to_pylist(), [], []
            for part, n in zip(where, batch.column(3).to_pylist(), strict=True):
                if part != now:
                    now, held, offset = part, np.empty(0, np.uint32), table[part][1]
                    stream = SequenceFile(table[part][0]).stream()
                while len(held) < n:
                    held = np.concatenate((held, next(stream)))
                crcs.append(zlib.crc32(held[:n].astype("<u4").tobytes()))
                begins.append(offset)
                held, offset = held[n:], offset + n
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(begins, pa.int64()), batch.column(3), pa.array(crcs, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    rows = index.select("part", "at", F.col(key).alias("key"), "n_tokens").repartitionByRange(len(starts), "part").sortWithinPartitions("part", "at")
    return rows.mapInArrow(read, T.StructType([T.StructField("key", index.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])).withColumnRenamed("key", key)
