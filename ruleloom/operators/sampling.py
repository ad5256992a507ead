"""Seeded samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hash(columns: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in columns])


def uniform(df: DataFrame, key: list[str], *, seed: int = 0, ratio: float | None = None, size: int | None = None) -> DataFrame:
    """A sample without replacement that any run repeats: rows with the least key hashes (``size``), or below a share (``ratio``)."""
    h = _hash(key, seed)
    if size is not None:
        return df.orderBy(h, *key).limit(size)
    return df.where(F.pmod(h, F.lit(1_000_000_007)) < int((ratio or 0) * 1_000_000_007))


def split(df: DataFrame, key: list[str], *, seed: int = 0, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """``part``: train, valid or test by a hash of the key."""
    u = F.pmod(_hash(key, seed), F.lit(10_000)) / 10_000
    return df.withColumn("part", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


def random_walk(df: DataFrame, key: str, columns: list[str], *, starts: int, steps: int, seed: int = 0) -> DataFrame:
    """Walks ``walk, step, key``: from a row by one of its values (the larger its group, the likelier) to another row with it.

    A step joins the few walkers with value groups; a group is one aggregated row
    that keeps the member with the least hash for the step, so no group is gathered.
    """
    spark = df.sparkSession
    tall = df.select(F.col(key).alias("id"), F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))).where("v is not null")
    sizes = tall.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1")
    now = uniform(df.select(F.col(key).alias("id")), ["id"], seed=seed, size=starts).select(F.col("id").alias("walk"), "id")
    now = spark.createDataFrame(now.collect(), now.schema)  # ``starts`` rows
    out = now.select("walk", F.lit(0).alias("step"), "id")
    for s in range(1, steps + 1):
        choices = now.join(tall, "id").join(sizes, ["c", "v"])
        draw = F.pow(F.pmod(F.xxhash64(F.lit(seed + s), "walk", "c"), F.lit(1_000_003)) / 1_000_003 + 1e-9, 1.0 / F.col("n"))
        pick = choices.groupBy("walk").agg(F.max_by(F.struct("c", "v", "id"), draw).alias("p")).select("walk", "p.*")
        member = F.min_by("t_id", F.xxhash64(F.lit(seed + s), "walk", F.col("t_id").cast("string")))
        nxt = pick.join(tall.select("c", "v", F.col("id").alias("t_id")), ["c", "v"]).where("t_id <> id").groupBy("walk").agg(member.alias("id"))
        now = spark.createDataFrame(nxt.collect(), nxt.schema)  # at most ``starts`` rows
        out = out.union(now.select("walk", F.lit(s).alias("step"), "id"))
    return out.withColumnRenamed("id", key)


def representatives(df: DataFrame, key: str, vector: str, cluster: str, ratio: float) -> DataFrame:
    """The most central share of each cluster: least summed cosine distance to all its members.

    The sum over a cluster's members is a dot product with the sum of their unit
    vectors, so members are never paired.
    """
    from pyspark.sql import Window

    from ..functions import vectors as V

    v = F.col(vector)
    norm = F.sqrt(V.dot(v, v))
    unit = df.select(key, cluster, F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0))).alias("u"))
    sums = unit.select(cluster, F.posexplode("u").alias("i", "x")).groupBy(cluster, "i").agg(F.sum("x").alias("x")).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    sizes = unit.groupBy(cluster).agg(F.count("*").alias("n"))
    scored = unit.join(sums, cluster).join(sizes, cluster).select(key, cluster, "n", F.round(F.col("n") - V.dot(F.col("u"), F.col("total")), 9).alias("distance"))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy("distance", key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= F.greatest(F.lit(1), F.floor(ratio * F.col("n")))).drop("n")
