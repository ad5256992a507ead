"""Discovery: from tables to the most relevant and diverse rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..predicates import Predicate
from ..schema import TableSet
from . import bounded, scoring
from .config import Config
from .lattice import Found, search


def predicate_space(tables: TableSet, c: Config) -> tuple[list[Predicate], list[Predicate], int, int]:
    """Predicates, consequences, the support threshold and the number of ordered pairs."""
    rows = tables.rows()
    total = sum(rows.values())
    pairs = total * total
    sigma = int(c.support * pairs)
    space = stats.equality_space(tables, c.share)
    constants = dict(stats.constant_space(tables, c.low, c.high)) if c.constants else {}
    space = stats.only_equal([*space, *constants])
    right = stats.consequences(space)
    space = stats.frequent_enough(tables, space, constants, sigma, max(rows.values(), default=0))
    space = stats.without_keys(tables, space, rows, c.key_share)
    if constants:
        plans = None
        for t, col in sorted({(p.left.table, p.left.column) for p in constants}):
            one = stats.histogram(tables.table(t), col).agg(F.count_if(F.col("n") > 1).alias("n")).select(F.lit(t).alias("t"), F.lit(col).alias("c"), "n")
            plans = one if plans is None else plans.union(one)
        repeated = {(r["t"], r["c"]): r["n"] for r in plans.collect()}
        space = stats.without_small_domains(space, repeated, c.small_domain)
    if not c.cross or all(not p.is_constant for p in right):
        space = stats.without_cross(space)
    return space, [p for p in right if p in set(space)], sigma, pairs


def mine(tables: TableSet, c: Config) -> tuple[list[Found], int]:
    """All minimal valid rules, and the number of ordered pairs."""
    space, right, sigma, pairs = predicate_space(tables, c)
    return search(tables, space, right, sigma=sigma, delta=c.confidence, max_x=c.max_x, prune=c.prune), pairs


def discover(spark: SparkSession, tables: TableSet, c: Config | None = None, model: scoring.Model | None = None) -> DataFrame:
    """The k rules chosen, one a row: rule, lhs_support, supp, conf, rel, div, score."""
    c = c or Config()
    space, right, sigma, pairs = predicate_space(tables, c)
    frontier = bounded.Frontier(tables, space, right, sigma, c.confidence, c.max_x)
    return scoring.frame(spark, bounded.choose(frontier, c, pairs, model))
