"""Entity matching: hashing, mixture models, propagated labels, serialised records and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .components import connected_components


def lsh_table(df: DataFrame, key: str, vector: str, *, bits: int, dim: int, seed: int = 0) -> DataFrame:
    """``key, bucket``: random-hyperplane buckets, an index to join on."""
    return df.select(key, V.lsh_bucket(F.col(vector), V.planes(bits, dim, seed)).alias("bucket"))


def projected_pairs(df: DataFrame, key: str, vector: str, *, bucket_length: float = 0.01, tables: int = 30, threshold: float = 0.5, seed: int = 1) -> DataFrame:
    """Approximate pairs within a Euclidean distance by bucketed random projections."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    ready = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(ready)
    j = model.approxSimilarityJoin(ready, ready, threshold, distCol="distance")
    return j.select(F.col(f"datasetA.{key}").alias("l"), F.col(f"datasetB.{key}").alias("r"), "distance").where("l < r")


def mixture_match(pairs: DataFrame, features: list[str], seed: int = 1) -> DataFrame:
    """Unsupervised matches: a two-part Gaussian mixture over scaled similarities; the part with the larger mean matches."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler

    ready = VectorAssembler(inputCols=features, outputCol="_raw").transform(pairs)
    ready = MinMaxScaler(inputCol="_raw", outputCol="_scaled").fit(ready).transform(ready)
    model = GaussianMixture(k=2, featuresCol="_scaled", predictionCol="_part", seed=seed).fit(ready)
    means = [float(g.mean.toArray().mean()) for g in model.gaussians]
    best = max(range(2), key=lambda i: means[i])
    return model.transform(ready).withColumn("match", (F.col("_part") == best).cast("int")).drop("_raw", "_scaled", "_part", "probability")


def scored_pairs(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], left: str, right: str, threshold: float) -> DataFrame:
    """A pluggable pair classifier: any function of two series of texts or vectors."""
    score = F.pandas_udf(scorer, "double")(F.col(left), F.col(right))
    return pairs.withColumn("score", score).withColumn("match", (F.col("score") > threshold).cast("int"))


def embedding_match(pairs: DataFrame, left: str, right: str, threshold: float) -> DataFrame:
    """1 where the cosine of two embeddings is over the threshold."""
    return pairs.withColumn("match", (V.cosine_similarity(F.col(left), F.col(right)) > threshold).cast("int"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: entity labels, least node of each connected component."""
    return connected_components(edges, a, b)


def entity_ids(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, entity``: ``S<least node>``."""
    return components(edges, a, b).select("node", F.concat(F.lit("S"), F.col("root").cast("string")).alias("entity"))


# --- records ---------------------------------------------------------------------------


def serialise(columns: Iterable[str]) -> Column:
    """``COL name VAL value`` of each present column."""
    return F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"COL {c} VAL "), F.col(c).cast("string"))) for c in columns])


def flattened(columns: Iterable[str]) -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def leave_one_out(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each record once without each attribute."""
    parts = [F.struct(F.lit(i).alias("left_out"), flattened([c for c in columns if c != x]).alias("text")) for i, x in enumerate(columns)]
    return df.select(F.col(key), F.inline(F.array(*parts)))


def paired_columns(columns: list[str], left: str = "left_", right: str = "right_") -> list[str]:
    """Attributes that both sides of a pair table have."""
    a = {c.removeprefix(left) for c in columns if c.startswith(left)}
    b = {c.removeprefix(right) for c in columns if c.startswith(right)}
    return sorted(a & b)


def summarise(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """The ``most`` rarest tokens of each record in their order; COL and VAL always stay."""
    n = df.agg(F.count("*").alias("total"))
    tokens = df.select(F.col(key).alias("k"), F.posexplode(F.split(F.trim(text), r"\s+")).alias("p", "t"))
    idf = tokens.where("t not in ('COL', 'VAL')").groupBy("t").agg(F.countDistinct("k").alias("df")).crossJoin(F.broadcast(n)).select("t", F.log(F.col("total") / F.col("df")).alias("idf"))  # one row
    scored = tokens.join(idf, "t", "left")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.col("idf").isNull().desc(), F.desc("idf"), "p"))
    kept = scored.withColumn("rank", rank - F.count_if(F.col("idf").isNull()).over(Window.partitionBy("k"))).where(F.col("idf").isNull() | (F.col("rank") <= most))
    return kept.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), " ").alias("text")).withColumnRenamed("k", key)


def augment(c: Column, kind: str) -> Column:
    """Deterministic augmentations of a serialised record: tokens are picked by hash."""
    words = F.split(F.trim(c), r"\s+")
    mark = lambda w: w.isin("COL", "VAL")
    if kind == "drop_token":
        out = F.filter(words, lambda w, i: mark(w) | (F.pmod(F.xxhash64(w, i), F.lit(8)) != 0))
    elif kind == "drop_len":
        out = F.filter(words, lambda w: mark(w) | (F.length(w) > 2))
    elif kind == "drop_sym":
        out = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^\w]", "")), lambda w: F.length(w) > 0)
    elif kind == "drop_same":
        out = F.filter(words, lambda w, i: mark(w) | (F.array_position(words, w) == i + 1))
    elif kind == "swap":
        out = F.when(F.size(words) > 1, F.concat(F.array(F.get(words, F.lit(1)), F.get(words, F.lit(0))), F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))))).otherwise(words)
    elif kind == "drop_col":
        return F.trim(F.regexp_replace(c, r"COL \S+ VAL (?:(?!COL \S+ VAL ).)*$", ""))  # the last column
    elif kind in ("del", "ins"):
        # A place by the record's hash; one to four tokens go from there, or one token is said twice.
        at = F.pmod(F.xxhash64(c), F.size(words).cast("long")).cast("int")
        span = F.pmod(F.xxhash64(c, F.lit(1)), F.lit(4)).cast("int") + 1
        if kind == "del":
            out = F.filter(words, lambda w, i: mark(w) | (i < at) | (i >= at + span))
        else:
            out = F.flatten(F.transform(words, lambda w, i: F.when((i == at) & ~mark(w), F.array(w, w)).otherwise(F.array(w))))
    else:
        raise ValueError(kind)
    return F.array_join(out, " ")


def append_column(c: Column) -> Column:
    """A serialised record whose first column's value is appended to its last column, and that first column is gone.

    Records of fewer than two columns stay as they are.
    """
    first = F.regexp_extract(c, r"^COL \S+ VAL (.*?) ?(?=COL \S+ VAL )", 1)
    rest = F.regexp_replace(c, r"^COL \S+ VAL .*?(?=COL \S+ VAL )", "")
    return F.when(c.rlike(r"^COL \S+ VAL .*COL \S+ VAL "), F.trim(F.concat_ws(" ", F.trim(rest), F.trim(first)))).otherwise(c)


def tag_entities(c: Column) -> Column:
    """Numbers of a text as ``NUM(...)`` and product codes (letters and digits mixed, five or more) as ``ID(...)``."""
    coded = F.regexp_replace(c, r"\b(?=[0-9A-Za-z]*[0-9])(?=[0-9A-Za-z]*[A-Za-z])([0-9A-Za-z]{5,})\b", "ID($1)")
    return F.regexp_replace(coded, r"(?<![\w.(])(\d+(?:\.\d+)?)(?![\w.)])", "NUM($1)")


def normalise_numbers(c: Column) -> Column:
    """Numbers without thousands separators and trailing zeros of decimals."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=\d),(?=\d{3}\b)", ""), r"(\d+\.\d*?[1-9])0+\b|(\d+)\.0+\b", "$1$2")


# --- metrics ---------------------------------------------------------------------------


def metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, recall, precision, F1, MAE and MSE in one pass."""
    y, p = F.col(truth), F.col(predicted)
    tp, fp, fn = F.count_if((y == 1) & (p == 1)), F.count_if((y != 1) & (p == 1)), F.count_if((y == 1) & (p != 1))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    r = df.agg(F.count("*").alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.avg((y == p).cast("double")).alias("accuracy"), F.avg(F.abs(y - p).cast("double")).alias("mae"), F.avg(F.pow((y - p).cast("double"), F.lit(2.0))).alias("mse"))
    c = F.col
    return r.select("n", "accuracy", safe(c("tp"), c("tp") + c("fn")).alias("recall"), safe(c("tp"), c("tp") + c("fp")).alias("precision"), safe(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"), "mae", "mse")
