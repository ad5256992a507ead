"""Support and confidence of rules over any number of tuple variables, without listing assignments."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..predicates import Predicate
from ..schema import TableSet, normal_null
from .support import _BIG, _all, _product


def chain_support(tables: TableSet, lhs: Iterable[Predicate], rhs: Predicate, variables: dict[int, str]) -> DataFrame:
    """One row, ``lhs_support`` and ``support``: ordered assignments of rows to ``variables`` that satisfy the left side, and the whole rule.

    Every variable's rows are counted by the columns that predicates use, and counts are multiplied join by join; a
    column is summed away as soon as no predicate left needs it, so what is shuffled has one row a combination of live
    values.  Null and empty values satisfy no predicate of the left side; values of the consequence agree with their
    like, nulls too.  An empty table gives zeros.  Raises if a variable is tied to no other by an equality.
    """
    lhs = list(lhs)
    if any(p.is_ml for p in (*lhs, rhs)) or rhs.op != "==":
        raise ValueError("similarity predicates and comparing consequences can't be counted")
    ties = [p for p in lhs if not p.is_constant]
    ends = [o for o in (rhs.left, rhs.right) if o]
    name = lambda o: f"t{o.variable}__{o.column}"

    def counted(v: int) -> DataFrame:
        df = tables.table(variables[v])
        df = df.where(_all(F.coalesce(df[p.left.column].cast("string") == F.lit(p.constant), F.lit(False)) for p in lhs if p.is_constant and p.left.variable == v))
        used = sorted({o for p in ties for o in (p.left, p.right) if o.variable == v}, key=str)
        keys = [normal_null(df, o.column).alias(name(o)) for o in used]
        values = [(F.coalesce(df[o.column].cast("string") == F.lit(rhs.constant), F.lit(False)) if rhs.is_constant else df[o.column].cast("string")).alias(f"y{i}") for i, o in enumerate(ends) if o.variable == v]
        out = df.select(*keys, *values).dropna(subset=[name(o) for o in used])
        return out.groupBy(*out.columns).agg(F.count("*").cast(_BIG).alias("n"))

    def test(p: Predicate) -> Column:
        a, b = F.col(name(p.left)), F.col(name(p.right))
        return {"==": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[p.op]

    def live(df: DataFrame, todo: list[Predicate]) -> DataFrame:
        needed = {name(o) for p in todo for o in (p.left, p.right)}
        if {"y0", "y1"} <= set(df.columns):
            df = df.withColumn("y", F.col("y0").eqNullSafe(F.col("y1"))).drop("y0", "y1")
        keep = [c for c in df.columns if c in needed or c in ("y", "y0", "y1")]
        return df.groupBy(*keep).agg(F.sum("n").cast(_BIG).alias("n"))

    seen, out = {min(variables)}, counted(min(variables))
    todo = list(ties)
    within = lambda p: {o.variable for o in (p.left, p.right)}
    while True:
        own = [p for p in todo if within(p) <= seen]  # two columns of one variable
        todo = [p for p in todo if p not in own]
        out = live(out.where(_all(map(test, own))), todo)
        if len(seen) == len(variables):
            break
        near = {v: [p for p in todo if within(p) <= seen | {v} and within(p) & seen and v in within(p)] for v in variables if v not in seen}
        v = max(sorted(near), key=lambda x: sum(p.op == "==" for p in near[x]))
        if not any(p.op == "==" for p in near[v]):
            raise ValueError("a tuple variable is tied to no other by an equality")
        out = out.join(counted(v).withColumnRenamed("n", "m"), _all(map(test, near[v]))).withColumn("n", _product("n", "m")).drop("m")
        todo = [p for p in todo if p not in near[v]]
        seen.add(v)
    holds = F.col("y") if "y" in out.columns else F.col("y0")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return out.agg(total(F.col("n")).alias("lhs_support"), total(F.when(holds, F.col("n"))).alias("support"))
