"""Top-k, nearest neighbours and frequent words."""

from __future__ import annotations

import re

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows, in a total order."""
    return df.orderBy(F.desc(score), F.asc(tie)).limit(k)


def top_k_by(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group; Spark keeps k a group and task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def kth_bound(df: DataFrame, bound: str, k: int) -> DataFrame:
    """The k-th largest lower bound."""
    return df.orderBy(F.desc(bound)).limit(k).agg(F.min(bound).alias("bound"), F.count("*").alias("n"))


def top_sum(df: DataFrame, score: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.desc(score)).limit(k).agg(F.sum(score).alias("total"))


def frequent_words(df: DataFrame, text: str, k: int) -> DataFrame:
    """The k words in most rows."""
    words = df.select(F.explode(F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.length(w) > 0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(k)


def words_after_alnum(df: DataFrame, text: str, words: list[str], ratio: float) -> DataFrame:
    """Words that a digit or letter precedes directly in at least ``ratio`` of the rows that hold them."""
    t = F.col(text)
    tall = df.select(F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.contains(t, F.lit(w)).alias("has"), t.rlike(rf"[0-9A-Za-z]{re.escape(w)}").alias("led")) for w in words])))
    return tall.where("has").groupBy("word").agg((F.count_if("led") / F.count("*")).alias("ratio")).where(F.col("ratio") >= ratio)


def bucket_neighbours(queries: DataFrame, items: DataFrame, bucket: str, qid: str, qvec: str, iid: str, ivec: str, distance, k: int) -> DataFrame:
    """Nearest items of each query's bucket by a distance of two array columns."""
    q = queries.select(F.col(bucket).alias("_b"), F.col(qid).alias("q"), F.col(qvec).alias("_v"))
    i = items.select(F.col(bucket).alias("_b"), F.col(iid).alias("i"), F.col(ivec).alias("_w"))
    d: Column = distance(F.col("_v"), F.col("_w"))
    return top_k_by(q.join(i, "_b").where("q <> i").select("q", "i", (-d).alias("near")), ["q"], "near", "i", k).select("q", "i", (-F.col("near")).alias("distance"), "rank")


def nearest(items: DataFrame, chosen: Column, key: str, vector: str, k: int, *, query_block: int = 4096, item_block: int = 8192) -> DataFrame:
    """``q, i, distance, rank``: the k nearest rows by cosine distance of every row that ``chosen`` holds for, without a loss.

    Every query meets every row, in cells of at most about ``query_block`` queries and ``item_block``
    rows; a cell returns k rows a query.  Distances are compared to nine decimals and equal ones go by key; a
    vector of length 0 has distance 1; rows without key or vector are left out.
    """
    rows = items.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    asked = rows.where(chosen)
    n, m = rows.count(), asked.count()
    across, down = max(1, math.ceil(m / query_block)), max(1, math.ceil(n / item_block))

    def dealt(df: DataFrame, own: str, mine: int, other: str, others: int) -> DataFrame:
        # By row and not by key: rows that share a key don't share a cell.
        row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(mine)).cast("int")
        return df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), row.alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def unit(t: pa.Table) -> np.ndarray:
        v = np.array(t.column("v").to_pylist(), float)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        none = pa.table({"q": a.column("id").slice(0, 0), "i": a.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})
        if not a.num_rows or not b.num_rows:
            return none
        b = b.sort_by("id")
        x, y, xs, ys = unit(a), unit(b), a.column("id").to_numpy(), b.column("id").to_numpy()
        out = []
        for at in range(0, len(x), 256):
            d = np.round(1.0 - x[at : at + 256] @ y.T, 9)
            d[xs[at : at + 256, None] == ys[None, :]] = np.inf
            last = np.partition(d, min(k, len(y)) - 1, axis=1)[:, [min(k, len(y)) - 1]]
            r, c = np.nonzero((d <= last) & np.isfinite(d))
            by = np.lexsort((c, d[r, c], r))  # columns are in the order of keys
            r, c = r[by], c[by]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, c = r[best], c[best]
            out.append(pa.table({"q": xs[at + r], "i": ys[c], "distance": d[r, c]}))
        return pa.concat_tables(out)

    kind = items.schema[key].dataType.simpleString()
    met = dealt(asked, "x", across, "y", down).groupBy("x", "y").cogroup(dealt(rows, "y", down, "x", across).groupBy("x", "y"))
    near = met.applyInArrow(cell, f"q {kind}, i {kind}, distance double")
    return top_k_by(near.withColumn("near", -F.col("distance")), ["q"], "near", "i", k).select("q", "i", "distance", "rank")
