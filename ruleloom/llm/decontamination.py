"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document where the document holds at least ``threshold`` of
the item's distinct word shingles.  Shingles have ``k`` words; an item of fewer
words is one shingle of all its words, and is found wherever a document holds
them in a row.  Items are partitioned by their shingles' words and by their number
of shingles into powers of two.  Each partition has one sketch length: the
bottom-MinHash values of an item, as many as a document can miss at the partition's
upper bound and still hold ``threshold`` of the item, and one more.  So every
document that holds enough of an item meets at least one value of its sketch, with
no loss, however long the document is.  Each partition's sketch values are searched in
the document's set of that shingle width, and what they meet is verified by the
exact containment of the full sets.

Items travel to the tasks as sorted arrays in blocks of about ``block`` shingles; each
block takes one pass over the documents, without a shuffle, and all blocks take the
same way.  So memory is bounded whatever the benchmark's size, and nothing is
cut; the work grows with documents times blocks.

Defined cases: null and empty texts on either side match nothing; a document of
fewer words than a partition's shingles holds none of its items; equal items are each found;
repeated documents give repeated rows; null keys stay; keys may be of any type; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import per_chunk, staged, text_table
from .shingles import overlap, window_set, word_hashes


def sketch_length(n: int, threshold: float) -> int:
    """Sketch values of an item with ``n`` shingles: its size partition's length, at most ``n``."""
    upper = (1 << n.bit_length()) - 1
    return min(n, upper - math.ceil(threshold * upper - 1e-9) + 2)


def _words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass"))


def _sets(items: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """``item, width, n, set``: each item's shingles, of ``width`` words each."""
    kind = items.schema[key].dataType.simpleString()

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        words = [_words(x) for x in part.column(1).to_pylist()]
        widths = [min(k, len(w)) for w in words]
        sets = [window_set(w, width) for w, width in zip(words, widths, strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(widths, pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["item", "width", "n", "set"])

    return text_table(items, key, text).mapInArrow(per_chunk(make), f"item {kind}, width int, n long, set binary").where("n > 0")


class _Block:
    """Some items, partitioned by shingle width and size, ready to be searched for."""

    def __init__(self, rows: Iterable[tuple[object, int, bytes]], threshold: float):
        self.threshold = threshold
        self.items = [(item, width, np.frombuffer(bytes(s), "<u8")) for item, width, s in rows]
        parts: dict[tuple[int, int], list[int]] = {}
        for i, (_, width, s) in enumerate(self.items):
            parts.setdefault((width, len(s).bit_length()), []).append(i)
        self.partitions: list[tuple[int, np.ndarray, np.ndarray]] = []
        for (width, _), members in sorted(parts.items()):
            # Sets are in hash order, so their first values are the least.
            values = [s[: sketch_length(len(s), threshold)] for s in (self.items[i][2] for i in members)]
            sketch, owner = np.concatenate(values), np.repeat(members, [len(v) for v in values])
            order = np.argsort(sketch, kind="stable")
            self.partitions.append((width, sketch[order], owner[order]))

    def search(self, text: str | None) -> list[tuple[int, int]]:
        """The items that a text holds enough of, with the number of shared shingles."""
        words, sets, found = _words(text), {}, []
        for width, sketch, owner in self.partitions:
            if len(words) < width:
                continue
            if width not in sets:
                sets[width] = window_set(words, width)
            s = sets[width]
            low = np.searchsorted(s, sketch)
            low[low == len(s)] = 0
            for i in np.unique(owner[s[low] == sketch]).tolist():
                item = self.items[i][2]
                common = overlap(item, s)
                if common >= self.threshold * len(item) - 1e-9:
                    found.append((i, common))
        return found


def contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8, block: int = 1_000_000) -> DataFrame:
    """``key, item_key, n_item, n_shared, containment``: a row for every item that a document holds."""
    sets = staged(_sets(items, item_key, item_text, k).withColumn("at", F.monotonically_increasing_id()), "items")
    blocks = max(1, math.ceil((sets.agg(F.sum("n")).first()[0] or 0) / block))
    kind, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    found = None
    for b in range(blocks):
        # About ``block`` shingles of 8 bytes: bounded by the parameter.
        rows = sets.where(F.pmod(F.col("at"), F.lit(blocks)) == b).collect()
        known = _Block([(r["item"], r["width"], r["set"]) for r in sorted(rows, key=lambda r: r["at"])], threshold)

        def search(part: pa.RecordBatch, known: _Block = known) -> pa.RecordBatch:
            at, which, shared = [], [], []
            for i, x in enumerate(part.column(1).to_pylist()):
                for c, common in known.search(x):
                    at.append(i)
                    which.append(c)
                    shared.append(common)
            met = [known.items[c] for c in which]
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([x[0] for x in met], to_arrow_type(item_type)), pa.array([len(x[2]) for x in met], pa.int64()), pa.array(shared, pa.int64())], names=["key", "item", "n_item", "n_shared"])

        part = text_table(docs, key, text).mapInArrow(per_chunk(search), f"key {kind}, item {item_type.simpleString()}, n_item long, n_shared long")
        found = part if found is None else found.union(part)
    return found.select(F.col("key").alias(key), F.col("item").alias(item_key), "n_item", "n_shared", F.round(F.col("n_shared") / F.col("n_item"), 9).alias("containment"))


def oracle() -> str:
    """DuckDB SQL for the rows of ``contaminated`` over documents and benchmark (``k`` 5, threshold 0.8)."""
    words = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' ')))"
    return f"""
WITH b AS (SELECT item_id, w, least(5, len(w)) AS width FROM (SELECT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
bs AS (SELECT item_id, width, {grams} AS g FROM b),
bg AS (SELECT item_id, width, len(g) AS n, unnest(g) AS s FROM bs),
d AS (SELECT doc_id, w, width FROM (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL), (SELECT DISTINCT width FROM b) WHERE len(w) >= width),
dg AS (SELECT doc_id, width, unnest({grams}) AS s FROM d),
c AS (SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared FROM dg JOIN bg USING (width, s) GROUP BY doc_id, item_id, n)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, n_shared, round(n_shared / n_item, 9) AS containment FROM c WHERE n_shared >= 0.8 * n_item"""
