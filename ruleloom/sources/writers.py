"""Writers of rules, models, tables and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_rules(rules: DataFrame, path: str, fmt: str = "text") -> None:
    """Scored rules (``rule, supp, conf, rel, div, score``) as result lines, or in another format."""
    if fmt != "text":
        rules.write.mode("overwrite").format(fmt).save(path)
        return
    line = F.concat(F.lit("Rule : "), "rule", F.lit(", supp: "), F.col("supp").cast("string"), F.lit(", conf:"), F.col("conf").cast("string"), F.lit(", rel_score:"), F.col("rel").cast("string"), F.lit(", div_score:"), F.col("div").cast("string"), F.lit(", score:"), F.col("score").cast("string"))
    rules.select(line.alias("value")).write.mode("overwrite").text(path)


def write_rule_list(rules: DataFrame, path: str) -> None:
    rules.select("rule").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Marked tables, train and test tables: CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_model(spark: SparkSession, matrices: dict[str, np.ndarray], path: str) -> None:
    """Matrices by name as ``read_relevance_model`` reads them."""
    lines = [x for name, m in matrices.items() for x in (name, *(" ".join(map(repr, map(float, row))) for row in np.atleast_2d(m)))]
    write_lines(spark, lines, path)


def orc_to_csv(spark: SparkSession, path: str, to: str) -> DataFrame:
    """An ORC table written again as CSV."""
    write_csv(spark.read.orc(path), to)
    return spark.read.option("header", True).csv(to)


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """A small text file, lines in order."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(spark: SparkSession, measures: dict[str, float], path: str) -> None:
    """The measures of an evaluation as ``name : value`` lines."""
    write_lines(spark, [f"{k} : {v}" for k, v in measures.items()], path)


def write_index(spark: SparkSession, index: dict[str, list[str]], path: str, without: set[str] = frozenset()) -> None:
    """Each name with the names that go with it, ``name;a;b``; those of ``without`` are left out on both sides."""
    write_lines(spark, [";".join([k, *(v for v in vs if v not in without)]) for k, vs in index.items() if k not in without], path)


def write_matches(matches: DataFrame, path: str, model: str, left: tuple[str, str], right: tuple[str, str]) -> None:
    """Pairs ``l, r`` as match lines, one a left row."""
    head = f"{model};{left[0]}->{left[1]};{right[0]}->{right[1]}"
    pair = F.concat(F.col("l").cast("string"), F.lit("|"), F.col("r").cast("string"))
    matches.select(F.concat_ws(";", F.lit(head), pair).alias("value")).write.mode("overwrite").text(path)


def write_evidence(sets: DataFrame, path: str) -> None:
    """Evidence (``predicates`` array, ``count``) as ``p ^ p SUPP n`` lines."""
    sets.select(F.concat(F.array_join("predicates", " ^ "), F.lit(" SUPP "), F.col("count").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_parts(df: DataFrame, path: str, part: str = "part") -> None:
    """Train, valid and test tables: a CSV folder each, by the values of ``part``, in one pass."""
    df.write.mode("overwrite").partitionBy(part).option("header", True).csv(path)
