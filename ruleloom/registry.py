"""Where queries and their SQL are registered, and what they all need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .predicates import Rule, parse_rule
from .schema import TableSet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str, **more) -> TableSet:
    return TableSet({n: read(spark, sf_dir, n) for n in names}, **more)


def rule(text: str, table: str) -> Rule:
    return parse_rule(text, table)[0]
