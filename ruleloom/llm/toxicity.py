"""Toxicity: class-conditional Kneser-Ney models of how words are spelled.

A word is its characters between two boundary signs, and a model gives each sign's
likelihood after up to ``order - 1`` signs before it in the word.  The toxic and
the ordinary model discount their own counts of the longest sequences and hand
what the discounts free to one shared backoff: the interpolated Kneser-Ney model of
both classes together, which goes down order by order on continuation counts to
equal shares of the signs.  Discounts (one each for counts of 1, 2 and more) come
from the counts of counts of each order and class.  A rare expression has little
but the shared backoff, so both models give it nearly the same likelihood.

Toxic texts are mostly ordinary words.  So a toxic text is taken to draw each word
from the toxic model with probability ``rate`` and from the ordinary one otherwise:
its log-likelihood minus the ordinary one is, for a word, log(1 - rate + rate * T/O).
Summed over the n words of a text and normalised by length, by n (the difference a
word) and by the root of n (the same against its chance spread), the difference
is made a score by a logistic curve, fitted on training rows that the models did not see.

Training uses a bounded sample of labelled rows (``max_train``, by hash of the
key): all of them up to that number.  Words are counted by the distinct two-word
histories that they end in each class, so a passage that many rows share counts
once.  Counting is distributed; the driver gets the sample's words with two counts each.

Defined cases: null, empty and wordless texts have no evidence and get the curve's
value for none; nulls in label columns are no training rows; a key labelled twice
counts once, toxic if any label says so; repeated rows are scored each; equal texts
get equal scores; without training rows of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, forget, per_chunk, small_batches, staged, text_table
from .shingles import mix, word_spans

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_POWER = np.array([pow(int(_STEP), j, 1 << 64) for j in range(64)], _U)
_UNDO = _U(pow(int(_STEP), -1, 1 << 64))
_MARKS = b".,;:!?\"()[]{}|#*$%&<>/\\"
_STRIP = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def _clean(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_STRIP).translate(_LOWER)


def _signs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (and 1, so none is 0) of all words, each between two blanks; places within the words; the words' numbers."""
    joined = b" " + b"  ".join(words) + b" "
    a = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    blank = a == 32
    first = np.flatnonzero(blank)[::2]
    word = np.zeros(len(a), np.int32)
    word[first[1:]] = 1
    np.cumsum(word, out=word)
    place = np.arange(len(a), dtype=np.int32) - first.astype(np.int32)[word]
    return a + _U(1), place, word


def _longest(a: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Hash of the sequence of up to ``order`` signs that ends at each place: the sum of sign * BASE**(signs after it)."""
    out = a.copy()
    with np.errstate(over="ignore"):
        for j in range(1, min(order, len(a))):
            out[j:] += np.where(place[j:] >= j, a[:-j] * _POWER[j], _U(0))
    return out


def _context(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a sequence without its last sign."""
    with np.errstate(over="ignore"):
        return (h - last) * _UNDO


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and which of them hold."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and above, from the counts of counts."""
    n = [int((counts == i).sum()) for i in range(1, 5)]
    out = np.array([0.0, 0.5, 0.75, 0.9])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for i in (1, 2, 3):
            out[i] = min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) if n[i - 1] and n[i] else max(out[i - 1], y)
    return out


def _interpolated(counts: np.ndarray, context: np.ndarray, below: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likelihood of each sequence's last sign; the contexts and the weight that each gives to ``below``."""
    contexts, of = np.unique(context, return_inverse=True)
    off = discounts(counts)[np.minimum(counts, 3).astype(int)]
    total = np.bincount(of, counts, len(contexts))
    weight = np.where(total > 0, np.bincount(of, off, len(contexts)) / np.maximum(total, 1), 1.0)
    return (counts - off) / np.maximum(total, 1)[of] + weight[of] * below, contexts, weight


@dataclass
class ToxicityModel:
    """Log-likelihood ratios (toxic to ordinary) by sequence and, for unseen ones, by context; the score's curve."""

    keys: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    unseen: np.ndarray
    order: int = 8
    rate: float = 0.01
    curve: tuple[float, float, float] | None = None  # weights of both features and the level without evidence

    def word_ratios(self, words: list[bytes]) -> np.ndarray:
        """log T/O of whole words: sums over their signs."""
        if not words:
            return np.zeros(0)
        a, place, word = _signs(words)
        use = place > 0
        h, a = _longest(a, place, self.order)[use], a[use]
        at, seen = _find(self.keys, h)
        to, known = _find(self.contexts, _context(h, a))
        r = np.where(seen, self.ratio[at], np.where(known, self.unseen[to], 0.0)) if len(self.keys) else np.zeros(len(h))
        return np.bincount(word[use], r, len(words))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """The difference of the log-likelihoods over n and over the root of n, for each text."""
        out = np.zeros((len(texts), 2))
        cleaned = [_clean(x) for x in texts]
        data = b" ".join(cleaned)
        hashes, starts, ends = word_spans(data)
        if not len(hashes):
            return out
        _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        ratios = self.word_ratios([data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        shown = np.log(1 - self.rate + self.rate * np.exp(np.clip(ratios, -50, 50)))
        bounds = np.cumsum([len(x) + 1 for x in cleaned])
        owner = np.searchsorted(bounds, starts, side="right")
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        total = np.bincount(owner, shown[of], len(texts))
        out[:, 0], out[:, 1] = total / n, total / np.sqrt(n)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        *w, b = self.curve
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(w) + b, -30, 30)))


def fit_counts(words: list[bytes], counts: np.ndarray, order: int = 8, rate: float = 0.01) -> ToxicityModel:
    """The models from words and their counts, two columns (toxic, ordinary)."""
    if not words:
        return ToxicityModel(np.empty(0, _U), np.empty(0), np.empty(0, _U), np.empty(0), order, rate)
    a, place, word = _signs(words)
    use = np.flatnonzero(place > 0)
    keys, first, of = np.unique(_longest(a, place, order)[use], return_index=True, return_inverse=True)
    by_class = np.stack([np.bincount(of, counts[word[use], c], len(keys)) for c in (0, 1)], axis=1)
    at = use[first]
    del of, use, word
    length = np.minimum(order, place[at] + 1)
    context = _context(keys, a[at])
    # The last k signs of every longest sequence, for each k.
    tails = [np.zeros(len(at), _U)]
    with np.errstate(over="ignore"):
        for j in range(order):
            tails.append(tails[-1] + np.where(j < length, a[np.maximum(at - j, 0)] * _POWER[j], _U(0)))
    last = a[at]
    del a, place
    # Counts from the longest sequences down: how often they occur where nothing precedes them or
    # the order ends, and of how many different longer ones they are the tail.
    levels: list[tuple] = []
    above = (np.empty(0, _U), np.empty(0, np.int64))
    for k in range(order, 0, -1):
        whole = np.flatnonzero(length == k)
        seq = np.concatenate((tails[k][whole], tails[k][above[1]]))
        n = np.concatenate((by_class[whole].sum(axis=1), np.ones(len(above[1]))))
        member = np.concatenate((whole, above[1]))
        u, one, inverse = np.unique(seq, return_index=True, return_inverse=True)
        above = (u, member[one])
        levels.append((u, np.bincount(inverse, n, len(u)), _context(u, last[above[1]]), tails[k - 1][above[1]]))
    pooled = np.zeros(len(keys))
    p, known = np.full(1, 1.0 / (len(levels[-1][0]) + 1)), np.zeros(1, _U)
    for k, (u, n, head, tail) in enumerate(reversed(levels), start=1):
        p = _interpolated(n, head, p[np.searchsorted(known, tail)])[0]
        known = u
        whole = length == k
        pooled[whole] = p[np.searchsorted(known, keys[whole])]
    (toxic, contexts, left), (ordinary, _, right) = (_interpolated(by_class[:, c], context, pooled) for c in (0, 1))
    return ToxicityModel(keys, np.log(toxic) - np.log(ordinary), contexts, np.log(np.maximum(left, 1e-12)) - np.log(np.maximum(right, 1e-12)), order, rate)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> tuple[float, ...]:
    """Logistic regression by damped Newton steps: the weights of the features and the level."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    theta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        g = z.T @ (p - y) + ridge * theta
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(theta))
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return (*(theta[:-1] / scale).tolist(), float(theta[-1]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (two words before, word, class) of each slice, the words before as one hash."""
    forget()
    for batch in batches:
        for part in chunks(batch):
            ids, spelled, classes = [], [], []
            for text, toxic in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data = _clean(text)
                w, starts, ends = word_spans(data)
                if not len(w):
                    continue
                before = np.concatenate((np.ones(2, _U), w))
                with np.errstate(over="ignore"):
                    history = mix(before[: len(w)] * _STEP + before[1 : len(w) + 1])
                    ids.append(mix(history * _STEP + w) + _U(toxic))
                spelled += [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                classes.append(np.full(len(w), toxic, np.int64))
            if ids:
                u, first = np.unique(np.concatenate(ids), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(spelled, pa.binary()).take(pa.array(first)), pa.array(np.concatenate(classes)[first])], names=["id", "word", "y"])


def train_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = 12_000, order: int = 8, rate: float = 0.01) -> ToxicityModel:
    """A model from labelled rows: all of them, or about ``max_train`` chosen by hash of the key."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic")).where("key is not null and toxic in (0, 1)").groupBy("key").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    share = min(1.0, max_train / max(1, n))
    part = marked.where(F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1_000_003)) < F.lit(1_000_003 * share))
    # ``part`` has about max_train rows of two numbers: its size is bounded by the parameter.
    rows = text_table(docs, key, text).join(F.broadcast(part), "key").select("key", "text", F.col("toxic").cast("long").alias("toxic"))
    # Folds go by the text, so exact copies fall in one fold and the curve's rows are truly unseen.
    rows = staged(rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(4))), "training")
    seen, held = rows.where("fold > 0").drop("fold"), rows.where("fold = 0").drop("fold")
    counted = seen.mapInArrow(_count, "id long, word binary, y long").distinct().groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("ordinary")).toArrow()
    # Rows arrive in any order: sorted, so that each run sums alike.
    counted = counted.sort_by("word")
    words = counted.column("word").to_pylist()
    model = fit_counts(words, np.stack([counted.column(c).to_numpy() for c in ("toxic", "ordinary")], axis=1).astype(float) if words else np.zeros((0, 2)), order, rate)

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        x = model.features(part.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), part.column(2)], names=["a", "b", "y"])

    def measured(some: DataFrame) -> np.ndarray:
        got = some.mapInArrow(per_chunk(measure), "a double, b double, y long").toArrow()
        return np.array(sorted(zip(*(got.column(c).to_pylist() for c in ("a", "b", "y")), strict=True)), float).reshape(-1, 3)

    h = measured(held)
    if len(set(h[:, 2])) < 2:  # too few rows for a fold of their own
        h = measured(rows.drop("fold"))
    if len(set(h[:, 2])) == 2:
        model.curve = fit_curve(h[:, :2], h[:, 2])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """``key, score, predicted`` for every row, with ``carry`` beside the row itself as ``row``; repeated rows stay repeated."""
    small_batches(docs.sparkSession)
    # With ``carry`` the row travels once and its text is read off it.
    body = F.struct("*").alias("row") if carry else docs[text].cast("string").alias("text")
    rows = docs.select(docs[key].alias("key"), body)

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(1).field(text) if carry else part.column(1)
        scores = model.scores(texts.to_pylist())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), *([part.column(1)] if carry else [])], names=["key", "score", "predicted", *(["row"] if carry else [])])

    kind = docs.schema[key].dataType.simpleString()
    schema = T.StructType([*T._parse_datatype_string(f"key {kind}, score double, predicted int").fields, *(rows.schema.fields[1:] if carry else [])])
    return rows.mapInArrow(per_chunk(score), schema).withColumnRenamed("key", key)
