"""Table, schema, key, label, match, rule and evidence readers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..predicates import Rule, parse_rule
from ..schema import ForeignKey, TableSet


def read_table(spark: SparkSession, path: str, *, fmt: str | None = None, ratio: float | None = None, infer: bool = False, view: str | None = None) -> DataFrame:
    """A CSV (with header), ORC, Parquet, JSON or text table, by its ending unless ``fmt`` says.

    ``ratio`` keeps that share of the rows, at least one, lowest row hashes first.
    """
    fmt = fmt or (re.search(r"\.(csv|orc|parquet|json|txt)/?$", path) or [None, "parquet"])[1]
    reader = spark.read.option("header", True).option("inferSchema", infer) if fmt == "csv" else spark.read
    df = reader.format({"txt": "text"}.get(fmt, fmt)).load(path)
    if ratio is not None and ratio < 1:
        df = _lowest_share(df, ratio)
    if view:
        df.createOrReplaceTempView(view)
    return df


def _lowest_share(df: DataFrame, ratio: float) -> DataFrame:
    """The rows with the lowest hashes.  Only the hash range in which the share ends is sorted."""
    h = F.xxhash64(*df.columns)
    part = F.shiftright(h, 48)
    counts = sorted(tuple(r) for r in df.groupBy(part.alias("part")).count().collect())  # 65,536 ranges at most
    left, last = max(1, int(ratio * sum(n for _, n in counts))), None
    for last, n in counts:
        if n >= left:
            break
        left -= n
    if last is None:
        return df
    return df.where(part < last).union(df.where(part == last).orderBy(h, *df.columns).limit(left))


def read_directory(spark: SparkSession, paths: dict[str, str] | str, *, fmt: str = "csv", ratio: float | None = None) -> TableSet:
    """Every table of a folder, or of a name-to-path map."""
    if isinstance(paths, str):
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(paths)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        names = [f.getPath().getName() for f in files]
        paths = {n.removesuffix(f".{fmt}"): f"{paths.rstrip('/')}/{n}" for n in sorted(names) if n.endswith(f".{fmt}")}
    return TableSet({name: read_table(spark, p, fmt=fmt, ratio=ratio) for name, p in paths.items()})


def read_types(spark: SparkSession, path: str) -> dict[str, T.StructType]:
    """``relation;attribute;type`` lines as one schema a relation."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "integer": T.IntegerType(), "double": T.DoubleType(), "numeric": T.DoubleType(), "string": T.StringType()}
    out: dict[str, T.StructType] = {}
    for (line,) in spark.read.text(path).collect():  # a line a column
        parts = [p.strip() for p in line.split(";")]
        if len(parts) == 3:
            out.setdefault(parts[0], T.StructType()).add(parts[1], kinds.get(parts[2].lower(), T.StringType()))
    return out


def read_foreign_keys(spark: SparkSession, path: str) -> list[ForeignKey]:
    """Lines ``table.column`` (pairs of lines) or ``table.column->table.column``."""
    lines = [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]
    pairs = [re.split(r"\s*(?:->|=|,|;)\s*", x) for x in lines]
    flat = [p for x in pairs for p in x]
    return [ForeignKey(*a.split(".", 1), *b.split(".", 1)) for a, b in zip(flat[::2], flat[1::2], strict=False)]


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``left_id, right_id, label``."""
    return spark.read.option("header", True).schema("left_id long, right_id long, label int").csv(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Precomputed similarity matches: ``op;T->col;T->col;l|r;l|r...`` as one row a pair with l < r."""
    raw = spark.read.text(path).select(F.split("value", ";").alias("p"))
    heads = raw.select(F.col("p")[0].alias("model"), F.split(F.col("p")[1], "->").alias("a"), F.split(F.col("p")[2], "->").alias("b"), F.explode(F.expr("slice(p, 4, greatest(size(p) - 3, 0))")).alias("pair"))
    parts = heads.select("model", F.col("a")[0].alias("left_table"), F.col("a")[1].alias("left_column"), F.col("b")[0].alias("right_table"), F.col("b")[1].alias("right_column"), F.expr("try_cast(split(pair, '[|]')[0] as bigint)").alias("l"), F.expr("try_cast(get(split(pair, '[|]'), 1) as bigint)").alias("r"))
    return parts.where("l < r")


def read_rules(spark: SparkSession, path: str, table: str = "") -> list[tuple[Rule, dict[str, float]]]:
    """The rule lines of a result file; other lines are passed over."""
    lines = spark.read.text(path).where(F.col("value").contains("->")).collect()  # rules, not rows
    return [parse_rule(r[0], table) for r in lines]


def read_rule_table(spark: SparkSession, path: str) -> DataFrame:
    """Rule lines as rows: ``lhs`` (array), ``rhs``, ``supp``, ``conf``."""
    t = spark.read.text(path).where(F.col("value").contains("->"))
    body = F.regexp_replace(F.regexp_replace("value", r"^\s*Rule\s*:\s*", ""), r",\s*(supp|conf|rel_score|div_score|score)\s*:.*$", "")
    side = F.split(body, r"\s*->\s*")
    number = lambda k: F.expr(rf"try_cast(regexp_extract(value, '{k}\\s*:\\s*([-+0-9.eE]+)', 1) as double)")
    return t.select(F.split(F.trim(side[0]), r"\s*[\^⋀]\s*").alias("lhs"), F.trim(side[1]).alias("rhs"), number("supp").cast("long").alias("supp"), number("conf").alias("conf"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """``p ^ p ^ p SUPP n`` lines as ``predicates`` (array) and ``count``."""
    t = spark.read.text(path).where(F.col("value").rlike(r"SUPP\s*\d+"))
    return t.select(F.split(F.trim(F.regexp_replace("value", r"SUPP\s*\d+\s*$", "")), r"\s*[\^;]\s*").alias("predicates"), F.regexp_extract("value", r"SUPP\s*(\d+)", 1).cast("long").alias("count"))


def read_relevance_model(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """Named matrices: a line with a name, then lines of numbers."""
    out: dict[str, list[list[float]]] = {}
    name = ""
    for (line,) in spark.read.text(path).collect():  # a small model
        if line.strip() and not re.match(r"^[-+0-9.eE\s,]+$", line):
            name = line.strip().rstrip(":")
            out[name] = []
        elif line.strip():
            out.setdefault(name, []).append([float(x) for x in re.split(r"[\s,]+", line.strip())])
    return {k: np.array(v) for k, v in out.items()}


def read_predicates(spark: SparkSession, path: str) -> dict[str, int]:
    """Predicate text to id, by line number; PAD is line 0."""
    return {r[0].strip(): i for i, r in enumerate(spark.read.text(path).coalesce(1).collect()) if r[0].strip()}
