"""Toxicity, language, quality rules, licences and decontamination on small fixtures."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm import decontamination, licences, quality, queries
from ruleloom.llm.decontamination import contaminated, sketch_length
from ruleloom.llm.langid import fit_language, predict_language, subwords, train_language
from ruleloom.llm.licences import normalised_bigrams, scan_licences
from ruleloom.llm.shingles import shingle_set, word_hashes
from ruleloom.llm.toxicity import ToxicityModel, score_toxicity, train_toxicity
from tests.oracle import agree

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rows that every operator must take: null, empty, blank, symbols only, repeated, clashing names, long.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "!!! ... ###"), (5, "same text here"), (5, "same text here"), (None, "no key here"), (7, "word " * 50_000), (8, "Ünïcode İ 日本   \x1c 😀")]
SCHEMA = "doc_id long, text string, key string, score double, row string, n long, fp string"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "k", 1.0, "r", 2, "f") for i, t in rows], SCHEMA)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_word_hashes_follow_the_pattern():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice(["a", "B", "é", "日", " ", "\n", "\x0b", "\x1c", " ", "."]) for _ in range(r.randint(0, 30)))
        words = WORD.findall(text.translate(LOWER))
        hashes = word_hashes(text.encode())
        assert len(hashes) == len(words)
        assert len(set(hashes.tolist())) == len(set(words))
        assert len(shingle_set(text, 3)) == len(shingles(text, 3))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    agree(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_quality_by_hand(spark):
    text = "a b c\na b c\n\nx # y"
    r = quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (9, 9, 1, 1, 6)
    assert r["base_failed"] and not r["kept"]


def test_quality_odd_rows(spark):
    got = quality.quality(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r["kept"] is not None for r in got)
    assert sum(r["n_words"] == 0 and r["base_failed"] for r in got) == 3
    assert quality.quality(odd(spark, [])).count() == 0
    assert quality.passing(odd(spark)).columns == odd(spark).columns


def test_licences_by_hand(spark):
    rows = [(1, "words here\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, "nothing of the kind")]
    got = {r["doc_id"]: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["licence"] == "MIT" and got[2]["licence"] == "CC-BY-NC-4.0" and got[3]["licence"] is None and got[3]["dice"] == 0
    assert normalised_bigrams("A b, a B") == ["a b", "b a"]
    got = scan_licences(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r["licence"] is None for r in got)
    assert scan_licences(odd(spark, [])).count() == 0


def test_decontamination_against_sets(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 5, 8, 20, 60])))) for i in range(25)] + [(97, None), (98, ""), (99, "w1 w2")]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 80)))) for i in range(40)]
    for i, t in items[:12]:
        w = t.split()
        if len(w) > 12:
            w[3] = "changed"
        docs.append((100 + i, " ".join(r.choices(vocabulary, k=300) + w + r.choices(vocabulary, k=200))))
    docs += [(500, None), (501, ""), (502, "w1 w2"), (503, "x y W1\nw2 z"), (503, "x y W1\nw2 z"), (None, "a w1 w2 b"), (504, "w2 w1")]

    def held(a, b):
        width = min(5, len(WORD.findall((b or "").translate(LOWER))))
        if not width or len(WORD.findall((a or "").translate(LOWER))) < width:
            return 0
        s = shingles(b, width)
        n = len(s & shingles(a, width))
        return n if n >= 0.8 * len(s) else 0

    want = sorted((str(d), i, n) for d, a in docs for i, b in items if (n := held(a, b)))
    assert [x for x in want if x[1] == 99 and x[0] in ("503", "None")] == [("503", 99, 1), ("503", 99, 1), ("None", 99, 1)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 40):
        assert sorted((str(x["doc_id"]), x["item_id"], x["n_shared"]) for x in contaminated(frame, bench, block=block).collect()) == want
    for kind in ("double", "decimal(20,3)", "string"):
        odd_keys = bench.withColumn("item_id", F.col("item_id").cast(kind))
        assert contaminated(frame.withColumn("doc_id", F.col("doc_id").cast(kind)), odd_keys).count() == len(want)
    assert contaminated(frame, bench.limit(0)).count() == 0 and contaminated(frame.limit(0), bench).count() == 0
    assert all(sketch_length(n, 0.8) >= min(n, n - int(np.ceil(0.8 * n - 1e-9)) + 1) for n in range(1, 500))
    assert contaminated(odd(spark), bench).count() == 0


def test_decontamination_sql_takes_short_items(spark):
    import duckdb

    docs, items = [(1, "so the exact answer here, is"), (2, "exact answer"), (3, None), (4, "a b c d e f g")], [(1, "Exact answer here,"), (2, "answer"), (3, "b c d e f"), (4, " ")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    c = duckdb.connect()
    for name, df in (("documents", frame), ("benchmark", bench)):
        c.register(name, df.toPandas())
    got = sorted(tuple(x) for x in contaminated(frame, bench).select("doc_id", "item_id", "n_item", "n_shared").collect())
    assert got == sorted(x[:4] for x in c.sql(decontamination.oracle()).fetchall()) == [(1, 1, 1, 1), (1, 2, 1, 1), (2, 2, 1, 1), (4, 3, 1, 1)]


def language_rows(n=120):
    r = random.Random(3)
    parts = {"aa": ["ka", "mo", "ti"], "bb": ["schu", "ver", "ung"], "cc": ["ção", "lho", "nha"]}
    return [(i, " ".join("".join(r.choices(parts[k], k=r.randint(1, 3))) for _ in range(r.randint(3, 30))), k) for i, k in enumerate(r.choices(sorted(parts), k=n))]


def test_language_held_out(spark):
    rows = language_rows()
    train, test = rows[:80], rows[80:]
    model = train_language(spark.createDataFrame([*train, (900, None, "aa"), (901, "kati", None)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in predict_language(spark.createDataFrame(test, "doc_id long, text string, lang string"), model).collect()}
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in test]) > 0.95
    got = predict_language(odd(spark), model).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = dict(ODD)[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not text or not any(c.isalpha() for c in text))
        assert 0 <= r["score"] <= 1
    assert predict_language(odd(spark, []), model).count() == 0
    assert fit_language([], buckets=64).predict("abc") == ("und", 0.0, False)
    assert len(subwords("a", 64)) and not len(subwords("1 2", 64))


def test_language_table(spark):
    got = queries.op2_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.95


def toxic_rows(n=600):
    r = random.Random(5)
    plain, bad = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)], ["grubby", "vile", "rotten"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = r.choices(plain, k=r.randint(40, 120))
        if toxic:
            for _ in range(1 + len(words) // 25):
                words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([*labels[:450], (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = train_toxicity(docs, marked)
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    held = range(450, 600)
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.95
    assert all((got[i]["score"] >= 0.5) == (got[i]["predicted"] == 1) for i in got)
    strange = score_toxicity(odd(spark), model).collect()
    assert len(strange) == len(ODD) and all(0 <= r["score"] <= 1 for r in strange)
    carried = score_toxicity(odd(spark), model, carry=True).select("row.*")
    assert carried.columns == odd(spark).columns and carried.count() == len(ODD)
    assert score_toxicity(odd(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = train_toxicity(docs, spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType())])))
    assert isinstance(model, ToxicityModel) and [r["score"] for r in score_toxicity(docs, model).collect()] == [0.0, 0.0]
    assert licences.TEMPLATES
