"""Queries that must cover the whole job, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from ruleloom import queries
from ruleloom.operators import joins, ranking
from tests.oracle import agree


def recall_of(got, e, k=3):
    ids, x = e["vec_id"].to_numpy(), np.array(e["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        c = x @ x[at]
        c[at] = -9
        true = set(ids[np.argsort(-c)[:k]].tolist())
        hits += len(true & got.get(int(ids[at]), set()))
        total += k
    return hits / total


def test_lsh_neighbours_recall(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
        got = {}
        for r in queries.QUERIES["lsh_neighbours"](spark, f"/root/testdata/{sf}").collect():
            got.setdefault(r["q"], set()).add(r["i"])
        assert recall_of(got, e) >= 0.99


def test_nearest_in_small_blocks(spark):
    rows = [(i, [float(i % 7 == j) for j in range(7)]) for i in range(60)] + [(60, [0.0] * 7), (61, None), (None, [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ranking.nearest(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding", 3, query_block=2, item_block=9).orderBy("q", "rank").collect()
    found = {q: [(r["i"], r["distance"]) for r in got if r["q"] == q] for q in (0, 20, 40, 60)}
    assert found == {0: [(7, 0.0), (14, 0.0), (21, 0.0)], 20: [(6, 0.0), (13, 0.0), (27, 0.0)], 40: [(5, 0.0), (12, 0.0), (19, 0.0)], 60: [(0, 1.0), (1, 1.0), (2, 1.0)]}
    assert ranking.nearest(df.limit(0), F.col("vec_id") % 20 == 0, "vec_id", "embedding", 3).count() == 0


def test_similarity_links_cover_all_parts(spark):
    sf = "/root/testdata/sf0.01"
    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    sets = {k: frozenset(n[i : i + 3] for i in range(len(n) - 2)) for k, n in names.items()}
    similar = {(a, b) for a in set(sets.values()) for b in set(sets.values()) if 2 * len(a & b) >= len(a | b)}
    size, least = {}, {}
    for k, s in sorted(sets.items()):
        size[s] = size.get(s, 0) + 1
        least.setdefault(s, k)
    got = {r["p_partkey"]: (r["class_id"], r["links"]) for r in queries.QUERIES["similarity_links"](spark, sf).collect()}
    assert got == {k: (least[s], sum(size[b] for a, b in similar if a == s) - 1) for k, s in sets.items()}
    pairs = {(r["l"], r["r"]) for r in queries.QUERIES["similarity_class_pairs"](spark, sf).collect()}
    assert pairs == {(least[a], least[b]) for a, b in similar if least[a] < least[b]}


def test_similarity_links_odd_rows(spark):
    rows = [(1, "abcdef"), (2, "abcdef"), (2, "abcdefg"), (None, "abcdef"), (5, None), (6, "ab"), (7, "zzzz")]
    got = joins.similarity_links(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()
    assert sorted((r["k"] or 0, r["class_id"] or 0, r["links"]) for r in got) == [(0, 1, 3), (1, 1, 3), (2, 1, 3), (2, 2, 3), (5, 0, 0), (6, 0, 0), (7, 7, 0)]


def test_components_of_all_customers(spark):
    sf = "/root/testdata/sf0.1"
    keys = [r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for u in keys:
        if u != u * 3 % 1000:
            a, b = find(u), find(u * 3 % 1000)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in queries.QUERIES["label_components"](spark, sf).collect()}
    assert got == {x: find(x) for x in list(up)}


def test_predicate_pairs_of_whole_nations(spark):
    agree(spark, queries.QUERIES["ml_predicate_pairs"], queries.ORACLE_SQL["ml_predicate_pairs"], "/root/testdata/sf0.01")
