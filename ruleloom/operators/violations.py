"""Tuples that violate a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..predicates import Rule
from ..schema import TableSet
from .support import _all, _equal, _shape


def violations(tables: TableSet, rule: Rule, ids: tuple[str, str]) -> DataFrame:
    """``side, tid``: violating tuples of t0 or t1.

    Both sides are filtered by all their constants and keep only keys that two of their
    tuples have.  For ``t0.A = t1.B`` the smaller side drives: a tuple of the other
    side violates where its group has another driving tuple with a present value
    that differs from its own (an own null differs).  For a constant, tuples of its
    side whose value isn't it violate.  Groups are summed up before they meet.
    """
    joins, c0, c1 = _shape(rule)
    names = rule.tables()
    frames = []
    for v, consts in ((0, c0), (1, c1)):
        df = tables.table(names[v])
        keys = [df[(p.left if v == 0 else p.right).column].alias(f"k{i}") for i, p in enumerate(joins)]
        rhs = rule.rhs.left if rule.rhs.left.variable == v else rule.rhs.right if rule.rhs.right else None
        y: Column = df[rhs.column] if rhs is not None and rhs.variable == v else F.lit(None)
        rows = df.where(_all(_equal(df, p) for p in consts)) if consts else df
        rows = rows.select(*keys, df[ids[v]].alias("tid"), y.cast("string").alias("y"))
        names_ = [f"k{i}" for i in range(len(joins))]
        rows = rows.dropna(subset=names_) if names_ else rows
        big = rows.groupBy(*names_).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        frames.append(rows.join(big, names_, "left_semi") if names_ else rows)
    keys = [f"k{i}" for i in range(len(joins))]
    if rule.rhs.is_constant:
        v = rule.rhs.left.variable
        return frames[v].where(F.col("y").isNull() | (F.col("y") != rule.rhs.constant)).select(F.lit(v).alias("side"), "tid")
    sizes = [f.count() for f in frames]
    drive = 0 if sizes[0] <= sizes[1] else 1
    same = names[0] == names[1]
    # Of each group: how many present values, and of which kinds; two are enough to know that one differs.
    seen = frames[drive].where("y is not null and y <> ''").groupBy(*keys, "y").agg(F.count("*").alias("n"))
    group = seen.groupBy(*keys).agg(F.count("*").alias("kinds"), F.min("y").alias("only"), F.sum("n").alias("n"))
    other = frames[1 - drive].join(group, keys)
    own_null = F.col("y").isNull()
    differs = (F.col("kinds") > 1) | (F.col("only") != F.col("y"))
    # A tuple with a null never is its own partner: what drives has a present value.
    bad = F.when(own_null, F.col("n") > 0).otherwise(differs)
    out = other.where(bad).select(F.lit(1 - drive).alias("side"), "tid")
    return out.distinct() if same else out


def violation_count(tables: TableSet, rule: Rule, ids: tuple[str, str]) -> DataFrame:
    return violations(tables, rule, ids).agg(F.countDistinct("tid").alias("violations"))
