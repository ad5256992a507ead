"""Near-duplicates and components against brute force."""

import random
import re
from itertools import combinations

import pytest

from ruleloom.operators.components import connected_components
from ruleloom.llm.near_dup import near_duplicates
from tests.llm.test_text_operators import ODD, odd, shingles

CONTRACT = {"n_shingles", "component_id", "kept", "doc_id"}


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {n: v for n, v in roots(nodes, [e for e in edges if e[0] != e[1]]).items()}


def corpus(seed):
    """Exact copies, near copies around and beyond the threshold, a shared passage and plain texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = r.choices(words, k=40)
    docs = []
    for _ in range(6):
        base = r.choices(words, k=r.randint(30, 200))
        for _ in range(r.randint(3, 25)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 18))):
                copy[r.randrange(len(copy))] = r.choice(words)
            docs.append(copy)
            if r.random() < 0.2:
                docs.append(list(copy))
    for _ in range(60):
        docs.append(r.choices(words, k=r.randint(5, 60)) + (passage if r.random() < 0.6 else []))
    docs += [[], ["one"], ["one"], ["One"], ["two", "words"]]
    r.shuffle(docs)
    return [(i * 3 + 1, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize(("seed", "k", "percent", "more"), [(1, 3, 85, {}), (2, 5, 80, {}), (3, 3, 85, {"in_task": 2, "block": 4, "long_list": 3}), (4, 1, 60, {"block": 7, "in_task": 5})])
def test_against_all_pairs(spark, seed, k, percent, more):
    docs = corpus(seed)
    sets = {i: shingles(t, k) for i, t in docs}
    edges = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(sets, edges)
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=k, percent=percent, **more).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_odd_rows(spark):
    got = near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD) and set(got[0].asDict()) == CONTRACT
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[5]] == [5, 5] and by[2][0]["n_shingles"] == 0 and by[7][0]["n_shingles"] == 1
    assert by[None][0]["kept"] is False
    assert near_duplicates(odd(spark, [])).count() == 0


def test_nothing_in_common(spark):
    got = near_duplicates(spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id long, text string"), k=3, percent=85)
    assert got.where("kept").count() == 2 and re.match("long|bigint", dict(got.dtypes)["component_id"])
