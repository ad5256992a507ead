"""What the operators of this subpackage share: staging tables and Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..staging import released, shared_dir, staged

__all__ = ["CHUNK_BYTES", "chunks", "forget", "kept", "open_fs", "per_chunk", "released", "shared_dir", "small_batches", "staged", "text_table"]

#: Rows handed to numpy at once stay near this many bytes of text (one longer row goes alone).
CHUNK_BYTES = 2 << 20


def chunks(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES in the given string or binary column."""
    if batch.num_rows <= 1 or batch.column(column).nbytes <= CHUNK_BYTES:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from chunks(batch.slice(0, half), column)
    yield from chunks(batch.slice(half), column)


_KEPT: dict = {}


def kept(key: Hashable, make: Callable):
    """What ``make`` gives, made once and kept by the worker until ``forget``."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Lets go of all that is kept: workers go on from one operator to the next, and their tables would add up."""
    _KEPT.clear()


def per_chunk(make: Callable[[pa.RecordBatch], pa.RecordBatch], column: int = 1, *, keeps: bool = False) -> Callable:
    """A mapInArrow function that applies ``make`` to slices of bounded size; ``keeps``: it goes on with what the worker has kept."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        for batch in batches:
            for part in chunks(batch, column):
                yield make(part)

    return apply


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of about 8 MB at most, whatever the texts' lengths: workers and JVM buffers stay small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name))
    now = int(now.rstrip("bB")) if now.rstrip("bB").isdigit() else 0
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))


def text_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """Just the key and the text, as columns ``key`` and ``text``; other columns can't clash."""
    small_batches(df.sparkSession)
    return df.select(df[key].alias("key"), df[text].cast("string").alias("text"))


def open_fs(uri: str):
    """A pyarrow file system and path for a URI or a plain local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
