"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the n-grams (two to four letters, word ends included) of
its lower-cased letter runs, hashed into ``buckets`` rows of an embedding table.
Their average goes through a linear layer and a softmax.  Both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows
(``max_train``, by hash of the key).  A temperature and a rejection threshold are
calibrated on training rows kept apart: ``accepted`` says that a prediction is
at least as sure as ``target`` precision asks for.

Defined cases: null texts and texts without a letter are ``und`` with score 0
and not accepted; null languages are no training rows; without a training
row every prediction is ``und``; ties go to the first language in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_chunk, staged, text_table

_LETTERS: np.ndarray | None = None
_SIZES = (2, 3, 4)


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def subwords(text: str | None, buckets: int) -> np.ndarray:
    """The bucket of each subword; empty if the text has no letter."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, points, 0).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        hashed = np.zeros(len(codes), np.uint64)
        for n in range(1, max(_SIZES) + 1):
            if len(codes) < n:
                break
            hashed = hashed[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n == 1)
            if n not in _SIZES:
                continue
            # Only the first and last place may be a word's end; a lone end is no subword.
            ok = letter[: len(codes) - n + 1] | letter[n - 1 :]
            for i in range(1, n - 1):
                ok = ok & letter[i : len(codes) - n + 1 + i]
            h = hashed[ok]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((h >> np.uint64(40)).astype(np.int64) % buckets)
    return np.concatenate(out)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # each bucket's contribution to each language's logit
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str | None) -> np.ndarray | None:
        at = subwords(text, len(self.table))
        if not len(at) or not self.languages:
            return None
        return self.table[at].mean(axis=0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text)
        if z is None:
            return "und", 0.0, False
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.threshold)


def fit_language(rows: list[tuple[np.ndarray, np.ndarray, str]], *, buckets: int, dim: int = 16, epochs: int | None = None, rate: float = 0.5, target: float = 0.99, seed: int = 7) -> LanguageModel:
    """SGD over (buckets, counts, language) rows; a fifth of them calibrates."""
    names = sorted({r[2] for r in rows})
    if not names:
        return LanguageModel([], np.zeros((buckets, 0)), np.zeros(0))
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    cut = len(rows) // 5 if len(rows) >= 20 else 0
    held, train = order[:cut], order[cut:]
    table = random.normal(0, 0.1, (buckets, dim))
    weight, bias = np.zeros((len(names), dim)), np.zeros(len(names))
    at = {n: i for i, n in enumerate(names)}
    epochs = epochs or max(5, -(-8_000 // max(1, len(train))))
    steps, done = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in random.permutation(train):
            where, counts, name = rows[i]
            share = counts / counts.sum()
            hidden = share @ table[where]
            z = weight @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[at[name]] -= 1
            step = rate * (1 - done / steps)
            done += 1
            back = weight.T @ p
            weight -= step * np.outer(p, hidden)
            bias -= step * 0.1 * p
            table[where] -= step * 20 * share[:, None] * back
    model = LanguageModel(names, table @ weight.T, bias)
    check = held if cut else train
    z = np.stack([(rows[i][1] / rows[i][1].sum()) @ model.table[rows[i][0]] + bias for i in check])
    y = np.array([at[rows[i][2]] for i in check])

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 10, 60)
    model.temperature = float(grid[np.argmin([-np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid])])
    p = probabilities(model.temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == y
    by = np.argsort(-sure, kind="stable")
    precision = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
    good = np.flatnonzero(precision >= target)
    model.threshold = float(sure[by][good[-1]]) if len(good) else 1.0
    return model


def train_language(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = 3_000, buckets: int = 1 << 15) -> LanguageModel:
    """A model from rows with a language: at most about ``max_train``, by hash of the key."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = rows.select(key).count()
    hashed = F.pmod(F.xxhash64(F.lit("language"), F.col(key).cast("string"), F.length(text)), F.lit(1_000_003))
    part = rows.where(hashed < int(1_000_003 * min(1.0, max_train / max(1, n)))).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        where, counts, names = [], [], []
        for x, name in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            b, c = np.unique(subwords(x, buckets), return_counts=True)
            if len(b):
                where.append(b.astype(np.int32).tobytes())
                counts.append(c.astype(np.float32).tobytes())
                names.append(name)
        return pa.RecordBatch.from_arrays([pa.array(where, pa.binary()), pa.array(counts, pa.binary()), pa.array(names, pa.string())], names=["b", "c", "lang"])

    got = part.mapInArrow(per_chunk(count), "b binary, c binary, lang string").collect()
    rows = sorted((bytes(r["b"]), bytes(r["c"]), r["lang"]) for r in got)
    return fit_language([(np.frombuffer(b, np.int32), np.frombuffer(c, np.float32).astype(float), name) for b, c, name in rows], buckets=buckets)


def predict_language(docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, accepted`` for every row; repeated rows stay repeated."""
    kind = docs.schema[key].dataType.simpleString()

    def predict(part: pa.RecordBatch) -> pa.RecordBatch:
        got = [model.predict(x) for x in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=["key", "lang_pred", "score", "accepted"])

    return text_table(docs, key, text).mapInArrow(per_chunk(predict), f"key {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("key", key)
