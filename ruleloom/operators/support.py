"""Support and confidence of rules: counts by key, never pairs.

``supp(X)`` is the sum over keys x of ``n0(x) * n1(x)``: ordered pairs with the
diagonal.  Null and empty key parts drop out; consequence values may be null or
empty and then agree with their like.  In rules within one table a key that one
row alone has (counted before constants) is skipped.

Each side is pre-aggregated and both sides meet in one grouped aggregate (a union,
not a join), so a hot key costs no more than a cold one after the partial
aggregation.  Rules of one left side share one scan and one shuffle, whatever their consequences, and
a batch is one job.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..predicates import Predicate, Rule
from ..schema import TableSet, normal_null

_BIG = "decimal(38,0)"


def _equal(df: DataFrame, p: Predicate) -> Column:
    return F.coalesce(df[p.left.column].cast("string") == F.lit(p.constant), F.lit(False))


def _shape(rule: Rule) -> tuple[tuple[Predicate, ...], tuple[Predicate, ...], tuple[Predicate, ...]]:
    """Equalities between t0 and t1 (t0 on the left), constants on t0, constants on t1.

    Only equalities can be counted by key: comparisons and similarity predicates are refused (``pairs`` makes their tuple pairs).
    """
    joins, c0, c1 = [], [], []
    for p in (*rule.lhs, rule.rhs):
        if p.is_ml or p.op != "==":
            raise ValueError(f"{p} can't be counted by key; use pairs()")
    for p in rule.lhs:
        if p.is_constant:
            (c0 if p.left.variable == 0 else c1).append(p)
        elif p.left.variable == 0:
            joins.append(p)
        else:
            joins.append(p.swapped())
    return tuple(joins), tuple(c0), tuple(c1)


def _product(a: str, b: str) -> Column:
    return F.col(a).cast(_BIG) * F.col(b).cast(_BIG)


def _by_value(tables: TableSet, rule: Rule, y0: str | None, y1: str | None) -> DataFrame:
    """Counts ``a`` (t0 rows that satisfy its constants), ``b`` (t1) and ``every`` (t0 rows) by key and value."""
    joins, c0, c1 = _shape(rule)
    names = rule.tables()
    t0, t1 = tables.table(names[0]), tables.table(names[1])
    keys = [f"k{i}" for i in range(len(joins))]
    left = [normal_null(t0, p.left.column).alias(k) for k, p in zip(keys, joins, strict=True)]
    right = [normal_null(t1, p.right.column).alias(k) for k, p in zip(keys, joins, strict=True)]
    holds = lambda df, ps: F.expr("true") if not ps else _all(_equal(df, p) for p in ps)
    one_table = names[0] == names[1] and all(p.left.column == p.right.column for p in joins) and y0 == y1
    if one_table:
        rows = t0.select(*left, (t0[y0] if y0 else F.lit(None)).alias("y"), holds(t0, c0).cast("long").alias("a"), holds(t0, c1).cast("long").alias("b"), F.lit(1).cast("long").alias("every"))
    else:
        side0 = t0.select(*left, (t0[y0] if y0 else F.lit(None)).cast("string").alias("y"), holds(t0, c0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(1).cast("long").alias("every"))
        side1 = t1.select(*right, (t1[y1] if y1 else F.lit(None)).cast("string").alias("y"), F.lit(0).cast("long").alias("a"), holds(t1, c1).cast("long").alias("b"), F.lit(0).cast("long").alias("every"))
        rows = side0.union(side1)
    if keys:
        rows = rows.dropna(subset=keys)
    return rows.groupBy(*keys, "y").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("every").alias("every"))


def _all(columns: Iterable[Column]) -> Column:
    out = None
    for c in columns:
        out = c if out is None else out & c
    return F.lit(True) if out is None else out


def _finish(by_key: DataFrame, rule: Rule, fields: dict[str, Column], singles: bool) -> DataFrame:
    names = rule.tables()
    if names[0] == names[1] and not singles:
        by_key = by_key.where("every > 1")
    return by_key.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in fields.items()])


def support(tables: TableSet, rule: Rule, singles: bool = False) -> DataFrame:
    """One row: ``lhs_support`` and ``support`` of a rule; ``singles`` counts keys that one row alone has, too."""
    joins, c0, c1 = _shape(rule)
    keys = [f"k{i}" for i in range(len(joins))]
    p = rule.rhs if rule.rhs.is_constant or rule.rhs.left.variable == 0 else rule.rhs.swapped()
    if not p.is_constant:
        by_value = _by_value(tables, rule, p.left.column, p.right.column)
        by_key = by_value.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("every").alias("every"), F.sum(_product("a", "b")).alias("ab"))
        return _finish(by_key, rule, {"lhs_support": _product("a", "b"), "support": F.col("ab")}, singles)
    return constant_consequences(tables, rule.lhs, [p], singles)


def constant_consequences(tables: TableSet, lhs: Iterable[Predicate], consequences: list[Predicate], singles: bool = False) -> DataFrame:
    """Supports of rules with one left side and several constant consequences, from one scan.

    One row: ``lhs_support`` and ``support`` (or ``support_i`` for several).
    """
    lhs = tuple(lhs)
    rule = Rule.of(lhs, consequences[0])
    joins, c0, c1 = _shape(rule)
    names = rule.tables()
    t0, t1 = tables.table(names[0]), tables.table(names[1])
    keys = [f"k{i}" for i in range(len(joins))]
    holds = {0: lambda df: _all(_equal(df, p) for p in c0), 1: lambda df: _all(_equal(df, p) for p in c1)}
    zero = F.lit(0).cast("long")

    def side(df: DataFrame, sides: tuple[int, ...], columns: list[Column]) -> DataFrame:
        counted = [holds[0](df).cast("long").alias("a") if 0 in sides else zero.alias("a"), holds[1](df).cast("long").alias("b") if 1 in sides else zero.alias("b"), (F.lit(1).cast("long") if 0 in sides else zero).alias("every")]
        hits = [((holds[v](df) & _equal(df, p)).cast("long") if (v := p.left.variable) in sides else zero).alias(f"h{i}") for i, p in enumerate(consequences)]
        return df.select(*columns, *counted, *hits)

    if names[0] == names[1] and all(p.left.column == p.right.column for p in joins):
        rows = side(t0, (0, 1), [normal_null(t0, p.left.column).alias(k) for k, p in zip(keys, joins, strict=True)])
    else:
        rows = side(t0, (0,), [normal_null(t0, p.left.column).alias(k) for k, p in zip(keys, joins, strict=True)]).union(side(t1, (1,), [normal_null(t1, p.right.column).alias(k) for k, p in zip(keys, joins, strict=True)]))
    if keys:
        rows = rows.dropna(subset=keys)
    hits = [f"h{i}" for i in range(len(consequences))]
    by_key = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("a", "b", "every", *hits)])
    fields = {"lhs_support": _product("a", "b")}
    for i, p in enumerate(consequences):
        fields["support" if len(consequences) == 1 else f"support_{i}"] = _product(f"h{i}", "b" if p.left.variable == 0 else "a")
    return _finish(by_key, rule, fields, singles)


def paired_consequences(tables: TableSet, lhs: Iterable[Predicate], consequences: list[Predicate], singles: bool = False) -> DataFrame:
    """``i, lhs_support, support`` of rules with one left side and several consequences ``t0.y == t1.z``, from one scan.

    Each row is counted once under its key and once under its key and every consequence's value.
    """
    lhs = tuple(lhs)
    rule = Rule.of(lhs, consequences[0])
    joins, c0, c1 = _shape(rule)
    ends = [(p if p.left.variable == 0 else p.swapped()) for p in consequences]
    names = rule.tables()
    t0, t1 = tables.table(names[0]), tables.table(names[1])
    keys = [f"k{i}" for i in range(len(joins))]
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def side(df: DataFrame, on: list[Column], columns: list[str], first: bool, second: bool) -> DataFrame:
        values = F.array(*[F.struct(F.lit(i).alias("i"), df[c].cast("string").alias("y")) for i, c in enumerate(columns)])
        counted = [_all(_equal(df, p) for p in c0).cast("long").alias("a") if first else zero.alias("a"), _all(_equal(df, p) for p in c1).cast("long").alias("b") if second else zero.alias("b"), (one if first else zero).alias("every")]
        return df.select(*[x.alias(k) for x, k in zip(on, keys, strict=True)], *counted, F.inline(values))

    left = [normal_null(t0, p.left.column) for p in joins]
    if names[0] == names[1] and all(p.left.column == p.right.column for p in (*joins, *ends)):
        rows = side(t0, left, [p.left.column for p in ends], True, True)
    else:
        right = [normal_null(t1, p.right.column) for p in joins]
        rows = side(t0, left, [p.left.column for p in ends], True, False).union(side(t1, right, [p.right.column for p in ends], False, True))
    if keys:
        rows = rows.dropna(subset=keys)
    by_value = rows.groupBy(*keys, "i", "y").agg(*[F.sum(c).alias(c) for c in ("a", "b", "every")])
    by_key = by_value.groupBy(*keys, "i").agg(*[F.sum(c).alias(c) for c in ("a", "b", "every")], F.sum(_product("a", "b")).alias("ab"))
    if names[0] == names[1] and not singles:
        by_key = by_key.where("every > 1")
    got = by_key.groupBy("i").agg(F.sum(_product("a", "b")).cast("long").alias("lhs_support"), F.sum("ab").cast("long").alias("support"))
    return got


def evaluate(tables: TableSet, rules: list[Rule], width: int = 150, singles: bool = False) -> list[tuple[int, int]]:
    """``(lhs_support, support)`` of each rule; rules that share a left side share one scan and one shuffle of it.

    One job for each ``width`` plans; only two numbers a rule come to the driver.
    """
    plans: list[DataFrame] = []
    const: dict[tuple, list[int]] = {}
    paired: dict[tuple, list[int]] = {}
    for i, r in enumerate(rules):
        if r.rhs.is_constant:
            const.setdefault(r.lhs, []).append(i)
        else:
            paired.setdefault((r.lhs, tuple(sorted(r.tables().items()))), []).append(i)
    for (lhs, _), at in paired.items():
        numbers = F.array(*[F.lit(i) for i in at])
        got = paired_consequences(tables, lhs, [rules[i].rhs for i in at], singles)
        plans.append(got.select(numbers[F.col("i")].alias("i"), "lhs_support", "support"))
    for lhs, at in const.items():
        for part in (at[j : j + 100] for j in range(0, len(at), 100)):
            got = constant_consequences(tables, lhs, [rules[i].rhs for i in part], singles)
            many = [F.struct(F.lit(i).alias("i"), "lhs_support", F.col("support" if len(part) == 1 else f"support_{n}").alias("support")) for n, i in enumerate(part)]
            plans.append(got.select(F.inline(F.array(*many))))
    out: dict[int, tuple[int, int]] = {}
    for j in range(0, len(plans), width):
        job = plans[j]
        for p in plans[j + 1 : j + width]:
            job = job.union(p)
        out |= {r["i"]: (r["lhs_support"], r["support"]) for r in job.collect()}
    # A left side that no pair satisfies leaves no row.
    return [out.get(i, (0, 0)) for i in range(len(rules))]


def classify(lhs_support: int, supp: int, sigma: int, delta: float) -> str:
    if supp < sigma:
        return "invalid"
    return "valid" if lhs_support and supp / lhs_support >= delta else "intermediate"


def classified(counts: DataFrame, sigma: int, delta: float) -> DataFrame:
    """``counts`` with ``conf`` and ``class``."""
    conf = F.when(F.col("lhs_support") > 0, F.col("support") / F.col("lhs_support")).otherwise(F.lit(0.0))
    return counts.withColumn("conf", conf).withColumn("class", F.when(F.col("support") < sigma, "invalid").when(conf >= delta, "valid").otherwise("intermediate"))


def pairs(tables: TableSet, predicates: Iterable[Predicate], keep0: list[str], keep1: list[str], matches: dict[str, DataFrame] | None = None, ids: tuple[str, str] | None = None) -> DataFrame:
    """The tuple pairs themselves, for reports: equalities join, comparisons filter, ML predicates semi-join their match tables."""
    predicates = list(predicates)
    rule = Rule.of(predicates, predicates[0])
    names = rule.tables()
    t0 = tables.table(names[0]).alias("t0")
    t1 = tables.table(names[1]).alias("t1")
    col = lambda o: F.col(f"t{o.variable}.{o.column}")
    cond = F.lit(True)
    for p in predicates:
        if p.is_ml:
            continue
        a, b = col(p.left), col(p.right) if p.right else F.lit(p.constant)
        known = F.lit(True)
        for o in (p.left, p.right):
            if o and tables.kind(o.table, o.column) == "string":
                known = known & (col(o) != "")
        cond = cond & known & {"==": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[p.op]
    out = t0.join(t1, cond).select(*[F.col(f"t0.{c}").alias(f"t0_{c}") for c in keep0], *[F.col(f"t1.{c}").alias(f"t1_{c}") for c in keep1])
    for p in predicates:
        if p.is_ml and matches and ids:
            m = matches[p.model].select(F.col("l").alias("_l"), F.col("r").alias("_r"))
            out = out.join(m, (out[f"t0_{ids[0]}"] == m["_l"]) & (out[f"t1_{ids[1]}"] == m["_r"]), "left_semi")
    return out
