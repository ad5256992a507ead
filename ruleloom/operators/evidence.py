"""Evidence sets: bags of satisfied predicates with counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """``predicates`` (sorted names that hold) and ``count``, from rows or pairs."""
    held = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in predicates.items()])))
    return rows.select(held.alias("predicates")).groupBy("predicates").agg(F.count("*").alias("count"))


def adjust(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of both bags added."""
    return a.union(b).groupBy("predicates").agg(F.sum("count").alias("count"))


def matrix(sets: DataFrame, names: list[str]) -> DataFrame:
    """0/1 columns, one a predicate, with the support of each distinct row."""
    wide = sets.select(*[F.array_contains("predicates", n).cast("int").alias(n) for n in names], "count")
    return wide.groupBy(*names).agg(F.sum("count").alias("support"))


def partition(wide: DataFrame, names: list[str], k: int, threshold: int, seed: int = 1) -> DataFrame:
    """Clusters of evidence rows with support thresholds in proportion to their size, at least 1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=names, outputCol="features").transform(wide)
    parts = KMeans(k=k, seed=seed).fit(ready).transform(ready).groupBy("prediction").agg(F.sum("support").alias("support"))
    total = parts.agg(F.sum("support").alias("total"))
    return parts.crossJoin(F.broadcast(total)).select(F.col("prediction").alias("cluster"), "support", F.greatest(F.lit(1), F.floor(threshold * F.col("support") / F.col("total"))).cast("long").alias("threshold"))


def correlation(wide: DataFrame, names: list[str]) -> np.ndarray:
    """Weighted correlations of predicates: sums of products come from Spark, one number a pair."""
    sums = [F.sum(F.col("support") * F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    firsts = [F.sum(F.col("support") * F.col(a)).alias(f"m{i}") for i, a in enumerate(names)]
    r = wide.agg(F.sum("support").alias("n"), *sums, *firsts).first()
    n = float(r["n"] or 1)
    mean = np.array([float(r[f"m{i}"] or 0) / n for i in range(len(names))])
    second = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i, len(names)):
            second[i, j] = second[j, i] = float(r[f"s{i}_{j}"] or 0) / n
    cov = second - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return cov / np.outer(sd, sd)


def graphical_lasso(cov: np.ndarray, penalty: float = 0.05, shrink: float = 0.1, rounds: int = 100) -> np.ndarray:
    """Sparse precision matrix by block coordinate descent (Friedman, Hastie and Tibshirani 2008)."""
    p = len(cov)
    s = (1 - shrink) * cov + shrink * np.trace(cov) / p * np.eye(p)
    w = s + penalty * np.eye(p)
    betas = np.zeros((p, p))
    for _ in range(rounds):
        was = w.copy()
        for j in range(p):
            rest = [i for i in range(p) if i != j]
            v, t, beta = w[np.ix_(rest, rest)], s[rest, j], betas[j, rest]
            for _ in range(50):
                old = beta.copy()
                for i in range(len(rest)):
                    x = t[i] - v[i] @ beta + v[i, i] * beta[i]
                    beta[i] = np.sign(x) * max(abs(x) - penalty, 0) / v[i, i]
                if np.abs(beta - old).max(initial=0) < 1e-6:
                    break
            betas[j, rest] = beta
            w[rest, j] = w[j, rest] = v @ beta
        if np.abs(w - was).mean() < 1e-5:
            break
    theta = np.zeros((p, p))
    for j in range(p):
        rest = [i for i in range(p) if i != j]
        theta[j, j] = 1 / (w[j, j] - w[rest, j] @ betas[j, rest])
        theta[rest, j] = -betas[j, rest] * theta[j, j]
    return theta


def correlated(names: list[str], theta: np.ndarray, threshold: float, k: int) -> dict[str, list[str]]:
    """For each predicate, the ``k`` with the largest partial dependence over the threshold."""
    out = {}
    for i, n in enumerate(names):
        order = sorted((j for j in range(len(names)) if j != i and abs(theta[i, j]) > threshold), key=lambda j: (-abs(theta[i, j]), names[j]))
        out[n] = [names[j] for j in order[:k]]
    return out


def triples(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``subject, relation, object``: a row's attribute values."""
    return rows.select(F.col(key).alias("subject"), F.inline(F.array(*[F.struct(F.lit(c).alias("relation"), F.col(c).cast("string").alias("object")) for c in columns]))).where("object is not null and object <> ''")


def value_pair_triples(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Values that occur together in a row, with their counts."""
    return rows.dropna(subset=[a, b]).groupBy(F.col(a).cast("string").alias("subject"), F.col(b).cast("string").alias("object")).agg(F.count("*").alias("n")).select("subject", F.lit(f"{a}|{b}").alias("relation"), "object", "n")


def split_triples(t: DataFrame, seed: int = 0) -> DataFrame:
    """80 / 10 / 10 by a hash of the triple."""
    u = F.pmod(F.xxhash64(F.lit(seed), "subject", "relation", "object"), F.lit(10))
    return t.withColumn("part", F.when(u < 8, "train").when(u == 8, "valid").otherwise("test"))
