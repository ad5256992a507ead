"""Toxicity against Kneser-Ney models worked out with dictionaries, and on planted expressions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ruleloom.llm import queries
from ruleloom.llm.toxicity import discounts, fit_counts, score_toxicity, train_toxicity
from tests.llm.test_text_operators import odd, toxic_rows

SF = "/root/testdata/sf0.001"


def plain_models(words, counts, order):
    """Both models as functions of (last sign, signs before), by the definitions."""

    def spans(word):
        s = (" ", *word, " ")
        return [(s[max(0, i - order + 1) : i], s[i]) for i in range(1, len(s))]

    raw = [Counter(), Counter()]
    for word, both in zip(words, counts, strict=True):
        for span in spans(word):
            for c in (0, 1):
                raw[c][span] += both[c]
    tops = set(raw[0]) | set(raw[1])
    level = {order: {}}
    for k in range(order, 0, -1):
        table = level[k]
        for h, x in tops:
            if len(h) + 1 == k:
                table[h, x] = table.get((h, x), 0) + raw[0][h, x] + raw[1][h, x]
        level[k - 1] = dict(Counter((h[1:], x) for h, x in table if h)) if k > 1 else {}

    def discounted(table):
        off = discounts(np.array(list(table.values()), float))
        total, freed = defaultdict(float), defaultdict(float)
        for (h, _), n in table.items():
            total[h] += n
            freed[h] += off[min(int(n), 3)]
        return off, total, freed

    made = {k: discounted(level[k]) for k in range(1, order + 1)}
    signs = len(level[1])

    def pooled(h, x):
        k = len(h) + 1
        off, total, freed = made[k]
        n = level[k].get((h, x), 0)
        below = pooled(h[1:], x) if h else 1 / (signs + 1)
        return (n - off[min(int(n), 3)]) / total[h] + freed[h] / total[h] * below

    tables = [discounted({t: raw[c][t] for t in tops}) for c in (0, 1)]

    def likelihood(c, h, x):
        off, total, freed = tables[c]
        if not total[h]:
            return pooled(h, x)
        n = raw[c][h, x]
        return (n - off[min(int(n), 3)]) / total[h] + freed[h] / total[h] * pooled(h, x)

    return spans, likelihood, tops, tables


@pytest.mark.parametrize("order", [2, 3, 5, 8])
def test_likelihoods_are_kneser_ney(order):
    r = random.Random(order)
    words = sorted({"".join(r.choices("abécd", k=r.randint(1, 9))) for _ in range(150)})
    counts = np.array([[r.choice([0, 0, 1, 2, 5]), r.choice([1, 1, 2, 3, 9])] for _ in words], float)
    model = fit_counts([w.encode() for w in words], counts, order)
    spans, likelihood, tops, tables = plain_models(words, counts, order)
    known = [sum(math.log(likelihood(0, h, x) / likelihood(1, h, x)) for h, x in spans(w)) for w in words]
    assert model.word_ratios([w.encode() for w in words]) == pytest.approx(known, abs=1e-9)
    # Of an unseen sequence only the shared backoff is left: the ratio is that of the freed weights.
    new = "dcbaébd"
    share = lambda c, h: tables[c][2][h] / tables[c][1][h] if tables[c][1][h] else 1.0
    contexts = {h for h, _ in tops}
    want = sum(math.log(likelihood(0, h, x) / likelihood(1, h, x)) if (h, x) in tops else math.log(share(0, h) / share(1, h)) if h in contexts else 0.0 for h, x in spans(new))
    assert model.word_ratios([new.encode()])[0] == pytest.approx(want, abs=1e-9)


def test_likelihoods_sum_to_one():
    words = ["ab", "abc", "b", "cab", "bca"]
    counts = np.array([[1, 2], [0, 3], [2, 2], [4, 0], [1, 1]], float)
    _, likelihood, tops, _ = plain_models(words, counts, 3)
    for h in {h for h, _ in tops}:
        for c in (0, 1):
            assert sum(likelihood(c, h, x) for x in "abc ") == pytest.approx(1 - sum_unseen(likelihood, c, h), abs=1e-9)


def sum_unseen(likelihood, c, h):
    return likelihood(c, h, "an unseen sign")


def test_texts_sum_words_and_keep_order(spark):
    model = fit_counts([b"vile", b"plain", b"words"], np.array([[9, 0], [3, 40], [2, 30]], float))
    a, b = model.features(["Plain, words vile", "vile"]), model.features(["vile"])
    one = np.log(1 - model.rate + model.rate * np.exp(model.word_ratios([b"plain", b"words", b"vile"])))
    assert a[0] == pytest.approx([one.sum() / 3, one.sum() / math.sqrt(3)]) and a[1] == pytest.approx(b[0])
    assert (model.features([None, "", " .,! "]) == 0).all() and model.features([]).shape == (0, 2)
    # Whatever the neighbours in a batch, a text has its own value.
    texts = ["plain " * 3, None, "vile words", "", "unheard-of vile things " * 1000]
    assert model.features(texts) == pytest.approx(np.concatenate([model.features([t]) for t in texts]), abs=1e-12)


def test_rare_forms_of_a_stem_are_found(spark):
    """A stem in ever new forms: no form repeats between training and held-out rows."""
    rows, labels = toxic_rows(900)
    r = random.Random(9)
    rows = [(i, " ".join("grub" + "".join(r.choices("xyzuvw", k=4)) if w in ("grubby", "vile", "rotten") else w for w in t.split())) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = train_toxicity(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    got = {x["doc_id"]: x["predicted"] for x in score_toxicity(docs, model).collect()}
    assert np.mean([got[i] == y for i, y in labels[600:]]) > 0.95


def test_bound_copies_and_one_class(spark):
    rows, labels = toxic_rows(300)
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # A crowd of copies of one toxic row changes no word's count.
    crowd = docs.union(spark.createDataFrame([(1000 + i, rows[0][1]) for i in range(500)], "doc_id long, text string"))
    more = marked.union(spark.createDataFrame([(1000 + i, 1) for i in range(500)], "doc_id long, toxic int"))
    a, b = train_toxicity(docs, marked), train_toxicity(crowd, more)
    assert len(a.keys) == len(b.keys) and a.ratio == pytest.approx(b.ratio, abs=1e-12)
    assert len(train_toxicity(docs, marked, max_train=12).keys) < len(a.keys)
    one = train_toxicity(docs, marked.where("toxic = 1"))
    assert {x["score"] for x in score_toxicity(odd(spark), one).collect()} == {0.0}


def test_small_table_learns(spark):
    """Even at 399 labels the scores tell toxic documents from the others."""
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [x for x in got if x["held_out"]]
    pairs = [(a["score"] > b["score"]) + (a["score"] == b["score"]) / 2 for a in held if a["toxic"] for b in held if not b["toxic"]]
    assert np.mean(pairs) > 0.85 and len({x["predicted"] for x in got}) == 2
