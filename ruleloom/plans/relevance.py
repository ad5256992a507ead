"""The relevance model: rules to a score, learnt from ranked pairs of rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.violations import violation_count
from ..predicates import Rule
from ..schema import TableSet

PAD = "PAD"


def encode(rule: Rule, ids: dict[str, int], most: int = 5) -> tuple[list[int], list[int]]:
    """Predicate ids of both sides, the left filled up with PAD (0)."""
    lhs = [ids.get(str(p), 0) for p in rule.lhs][:most]
    return lhs + [0] * (most - len(lhs)), [ids.get(str(rule.rhs), 0)]


class RelevanceModel:
    """Mean of ReLU(embed w) of each side, joined, ReLU through a hidden layer, and an upper bound minus ReLU of the output."""

    names = ("embed", "left", "right", "hidden", "out")

    def __init__(self, vocabulary: int, dim: int = 16, width: int = 16, bound: float = 10.0, seed: int = 0):
        r = np.random.default_rng(seed)
        s = lambda *n: r.normal(0, 1 / np.sqrt(n[0]), n)
        self.bound = bound
        self.p = {"embed": r.normal(0, 0.5, (vocabulary, dim)), "left": s(dim, width), "right": s(dim, width), "hidden": s(2 * width, width), "out": np.abs(s(width, 1))}

    def forward(self, lhs: np.ndarray, rhs: np.ndarray):
        e, g = self.p["embed"][lhs], self.p["embed"][rhs]
        a, b = np.maximum(e @ self.p["left"], 0), np.maximum(g @ self.p["right"], 0)
        h0 = np.concatenate((a.mean(axis=1), b.mean(axis=1)), axis=1)
        h1 = np.maximum(h0 @ self.p["hidden"], 0)
        z = np.maximum(h1 @ self.p["out"], 0)[:, 0]
        return self.bound - z, (lhs, rhs, e, g, a, b, h0, h1, z)

    def score(self, lhs: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        return self.forward(np.asarray(lhs), np.asarray(rhs))[0]

    def gradients(self, trace, dscore: np.ndarray) -> dict[str, np.ndarray]:
        lhs, rhs, e, g, a, b, h0, h1, z = trace
        dz = (-dscore * (z > 0))[:, None]
        d1 = dz @ self.p["out"].T * (h1 > 0)
        d0 = d1 @ self.p["hidden"].T
        w = a.shape[2]
        da = (d0[:, None, :w] / a.shape[1]) * (a > 0)
        db = (d0[:, None, w:] / b.shape[1]) * (b > 0)
        out = {"out": h1.T @ dz, "hidden": h0.T @ d1, "left": np.einsum("nkd,nkw->dw", e, da), "right": np.einsum("nkd,nkw->dw", g, db), "embed": np.zeros_like(self.p["embed"])}
        np.add.at(out["embed"], lhs, da @ self.p["left"].T)
        np.add.at(out["embed"], rhs, db @ self.p["right"].T)
        return out

    def fit(self, first, second, label, *, epochs: int = 400, rate: float = 1e-3, batch: int = 128, seed: int = 0) -> list[float]:
        """Pairs of encoded rules; label 1: the first is the better.  Softmax cross-entropy, Adam."""
        (l1, r1), (l2, r2), y = map(np.asarray, first), map(np.asarray, second), np.asarray(label, float)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        random, step, losses = np.random.default_rng(seed), 0, []
        for _ in range(epochs):
            order, total = random.permutation(len(y)), 0.0
            for at in range(0, len(y), batch):
                i = order[at : at + batch]
                s1, t1 = self.forward(l1[i], r1[i])
                s2, t2 = self.forward(l2[i], r2[i])
                p = 1 / (1 + np.exp(np.clip(s2 - s1, -30, 30)))
                total += float(-(y[i] * np.log(p + 1e-12) + (1 - y[i]) * np.log(1 - p + 1e-12)).sum())
                d = (p - y[i]) / len(i)
                g1, g2 = self.gradients(t1, d), self.gradients(t2, -d)
                step += 1
                for k in self.names:
                    g = g1[k] + g2[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / max(1, len(y)))
        return losses

    def matrices(self) -> dict[str, np.ndarray]:
        return dict(self.p)

    def column(self, lhs: str, rhs: str):
        """The score as a column over arrays of ids, batch-wise."""
        model = self

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(model.score(np.stack(a.to_list()), np.stack(b.to_list())))

        return F.pandas_udf(run, "double")(F.col(lhs), F.col(rhs))


def rule_pairs(spark: SparkSession, tables: TableSet, rules: list[Rule], ids: dict[str, tuple[str, str]], *, pairs: int = 1000, seed: int = 0) -> DataFrame:
    """``left_id, right_id, label, part``: random pairs of rules; label 0 where the left one is violated more, ties rejected.

    Parts are 80 / 20 by a hash and share no row.
    """
    counts = None
    for i, r in enumerate(rules):
        one = violation_count(tables, r, ids[r.tables()[0]]).select(F.lit(i).alias("id"), "violations")
        counts = one if counts is None else counts.union(one)
    table = spark.createDataFrame(counts.collect(), "id int, violations long")  # one row a rule
    a, b = table.select(F.col("id").alias("left_id"), F.col("violations").alias("x")), table.select(F.col("id").alias("right_id"), F.col("violations").alias("y"))
    both = a.join(b, F.col("x") != F.col("y")).orderBy(F.xxhash64(F.lit(seed), "left_id", "right_id"), "left_id", "right_id").limit(pairs)
    return both.select("left_id", "right_id", (F.col("x") < F.col("y")).cast("int").alias("label"), F.when(F.pmod(F.xxhash64(F.lit(seed + 1), "left_id", "right_id"), F.lit(5)) < 4, "train").otherwise("test").alias("part"))
