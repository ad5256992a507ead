"""Strings and vectors against plain python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.functions import strings as S
from ruleloom.functions import vectors as V

PAIRS = [("", ""), ("", "abc"), ("ab", "abc"), ("ca", "abc"), ("kitten", "sitting"), ("MARTHA", "MARHTA"), ("same", "same"), ("日本語", "日本"), ("a  b", "a b"), (None, "x")]


def brute_damerau(a, b):
    """Breadth of edits by definition, with unrestricted transpositions."""
    from functools import lru_cache

    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        for k in range(i):
            for m in range(j):
                if i - k >= 2 and j - m >= 2 and a[k] == b[j - 1] and a[i - 1] == b[m]:
                    best = min(best, d(k, m) + (i - k - 2) + 1 + (j - m - 2))
        return best

    return d(len(a), len(b))


def test_kernels():
    assert S.damerau_py("ca", "abc") == 2 and S.osa_py("ca", "abc") == 3
    assert S.jaro_winkler_py("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-3)
    assert S.lcs_length_py("AGCAT", "GAC") == 2
    assert S.weighted_levenshtein_py("kitten", "sitting") == 3
    assert S.ngram_py("a", "b") == 1.0 and S.ngram_py("a", "b", compat=True) == 0.0
    assert S.sift4_py("", "abc") == 3 and S.sift4_py("abc", "abc") == 0
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randint(0, 6))) for _ in "12")
        assert S.damerau_py(a, b) == brute_damerau(a, b)
        assert S.osa_py(a, b) >= S.damerau_py(a, b)
        assert 0 <= S.ngram_py(a, b) <= 1 and 0 <= S.jaro_winkler_py(a, b) <= 1


def test_sift4_values_and_parts():
    assert S.sift4_py("This is the first string", "And this is another string", 5) == 11
    assert S.sift4_py("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Amet Lorm ispum dolor sit amet, consetetur adixxxpiscing elit.", 10) == 12
    # No reach: only places in step are compared; a swap of neighbours is one crossing.
    assert S.sift4_py("abcd", "xbcy", 0) == 2 and S.sift4_py("abcd", "acbd") == 1
    assert S.sift4_py("abcdefgh", "zzzzzzzz", max_distance=3) == 3 and S.sift4_py("ab", "ab", max_distance=3) == 0
    assert S.sift4_py("one two three", "one three", tokens=S.sift_words) == 1 and S.sift_ngrams(2)("abc") == ["ab", "bc"]
    assert S.sift4_py("listen", "silent", tokens=S.sift_letter_counts) == 0
    assert S.sift4_py("one twoo", "one two", tokens=S.sift_words, same=lambda x, y: S.sift_alike(x, y) > 0.7) == 0
    assert S.sift4_py("abcd", "acbd", crossing_cost=S.sift_longer_cost) == 1 and S.sift4_py("aab", "aab", run_value=lambda n: n / 2) == 2


def plain_ngram(a, b, n):
    """The recursion of the definition, with windows over an extended alphabet."""
    from functools import lru_cache

    x, y = [None] * (n - 1) + list(a), [None] * (n - 1) + list(b)

    def cost(i, j):
        g, h = x[i : i + n], y[j : j + n]
        real = [k for k in range(n) if not (g[k] is None and h[k] is None)]
        return sum(g[k] != h[k] for k in real) / len(real)

    @lru_cache(None)
    def d(i, j):
        return i + j if not i or not j else min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + cost(i - 1, j - 1))

    return d(len(a), len(b)) / max(len(a), len(b))


def test_ngram_distance_takes_newlines_as_characters():
    r = random.Random(8)
    for n in (2, 3):
        for _ in range(200):
            a, b = ("".join(r.choice("ab\n") for _ in range(r.randint(n, 7))) for _ in "12")
            assert S.ngram_py(a, b, n) == pytest.approx(0 if a == b else plain_ngram(a, b, n))


def test_words_in_patterns_are_taken_literally(spark):
    from ruleloom.operators.ranking import words_after_alnum

    df = spark.createDataFrame([("ab(c) x",), ("a.b 7.b",)], "t string")
    assert [r[0] for r in df.select(S.before_keyword(F.col("t"), "(c)")).collect()] == ["ab", ""]
    got = {r["word"]: r["ratio"] for r in words_after_alnum(df, "t", [".b", "(c)"], 0.0).collect()}
    assert got == {".b": 1.0, "(c)": 1.0}


def test_similarity_vector_takes_each_measure(spark):
    a, b = F.col("a"), F.col("b")
    pairs = [("kitten", "sitting"), ("same", "same"), ("ab", "x"), ("", "x"), (None, "x")]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.similarity_vector(a, b).alias("v")).collect():
        if not r["a"]:
            assert r["v"] == [0.0] * 16
            continue
        x, y = r["a"], r["b"]
        w = S.jaro_winkler_py(x, y)
        assert r["v"][3:10] == pytest.approx([S.damerau_py(x, y), S.osa_py(x, y), w, 1 - w, S.lcs_distance_py(x, y), S.metric_lcs_py(x, y), S.ngram_py(x, y)]) and r["v"][15] == S.sift4_py(x, y)


def test_columns(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", S.jaccard(a, b, 2).alias("j"), S.sorensen_dice(a, b, 2).alias("d"), S.cosine(a, b, 2).alias("c"), S.qgram_distance(a, b, 2).alias("q"), S.damerau(a, b).alias("m"), S.jaro_winkler(a, b).alias("w"), S.similarity_vector(a, b).alias("v")).collect()
    for r in got:
        if r["a"] is None:
            assert r["j"] is None and r["m"] is None and set(r["v"]) == {0.0}
            continue
        x, y = S.multiset_profile(r["a"], 2), S.multiset_profile(r["b"], 2)
        assert r["q"] == (0 if r["a"] == r["b"] else sum(abs(x[k] - y[k]) for k in {*x, *y}))
        if r["a"] != r["b"] and x and y:
            assert r["j"] == pytest.approx(len(x.keys() & y.keys()) / len(x.keys() | y.keys()))
            assert r["c"] == pytest.approx(sum(x[k] * y[k] for k in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())))
        assert r["m"] == S.damerau_py(r["a"], r["b"]) and len(r["v"]) == 16


def test_cleaning(spark):
    df = spark.createDataFrame([("Hello,World! (drop) 12345678901 五-3 ab-cd-abcdefghij",)], "x string")
    x = F.col("x")
    r = df.select(S.spaced_punctuation(x), S.drop_parenthesised(x), S.cjk_digits(x), S.letter_digit_runs(x), S.remove_stop_words(F.lower(x), ["(drop)"]), S.is_integer(F.lit("-12")), S.is_double(F.lit("1e5")), S.is_blank_or_punctuation(F.lit(" .,"))).first()
    assert r[0].startswith("hello , world !") and "drop" not in r[1] and "12345678901" not in r[1]
    assert "5-3" in r[2] and r[3] == "Hello-World-drop-3-ab-cd" and "drop" not in r[4] and r[5] and r[6] and r[7]


def test_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(r.normal(size=4).tolist(), r.normal(size=4).tolist()) for _ in range(20)]
    a, b = F.col("a"), F.col("b")
    p = V.planes(8, 4, 1)
    for row in spark.createDataFrame(rows, "a array<double>, b array<double>").select("a", "b", V.cosine_similarity(a, b), V.euclidean(a, b), V.l1(a, b), V.centred(a, b), V.lsh_bits(a, p), V.lsh_bucket(a, p), V.hamming(V.lsh_bits(a, p), V.lsh_bits(b, p)), V.relu(a), V.matmul(a, [[1.0, 2.0]] * 4)).collect():
        x, y = np.array(row[0]), np.array(row[1])
        assert row[2] == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
        assert row[3] == pytest.approx(np.linalg.norm(x - y)) and row[4] == pytest.approx(abs(x - y).sum()) and row[5] == pytest.approx(abs(x.mean() - y.mean()))
        bits = "".join("1" if x @ np.array(q) >= 0 else "0" for q in p)
        other = "".join("1" if y @ np.array(q) >= 0 else "0" for q in p)
        assert row[6] == bits and row[7] == int(bits, 2) and row[8] == sum(m != n for m, n in zip(bits, other, strict=True))
        assert row[9] == pytest.approx(np.maximum(x, 0)) and row[10] == pytest.approx([x.sum(), 2 * x.sum()])
