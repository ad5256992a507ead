"""Column statistics and the predicate filters that rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..predicates import Operand, Predicate
from ..schema import NUMERIC, TableSet, normal_null


def histogram(df: DataFrame, column: str) -> DataFrame:
    """``value, n`` of the present values."""
    return df.select(normal_null(df, column).alias("value")).dropna().groupBy("value").agg(F.count("*").alias("n"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: rows, present, distinct, distinct with frequency over one, average and sigma.

    Each column is one narrow aggregate; the scan reads only that column.
    """
    out = None
    for c in columns or df.columns:
        h = histogram(df, c)
        number = isinstance(df.schema[c].dataType, NUMERIC)
        x = F.col("value").cast("double")
        mean = F.sum(x * F.col("n")) / F.sum("n") if number else F.lit(None).cast("double")
        square = F.sum(x * x * F.col("n")) / F.sum("n") if number else F.lit(None).cast("double")
        one = h.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_present"), F.count("*").alias("n_distinct"), F.count_if(F.col("n") > 1).alias("n_repeated"), mean.alias("average"), square.alias("square"))
        one = one.select(F.lit(c).alias("column_name"), "n_present", "n_distinct", "n_repeated", F.round("average", 6).alias("average"), F.round(F.when(F.col("average").isNotNull(), F.sqrt(F.greatest(F.col("square") - F.col("average") * F.col("average"), F.lit(0.0)))), 6).alias("sigma"))
        out = one if out is None else out.union(one)
    return out


def shared_ratio(a: DataFrame, ca: str, b: DataFrame, cb: str, both: bool = True) -> DataFrame:
    """Sum of the smaller over sum of the larger frequencies; ``both=False`` counts only the first column's values."""
    x, y = histogram(a, ca).withColumnRenamed("n", "f"), histogram(b, cb).withColumnRenamed("n", "g")
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = x.join(y, x["value"].cast("string") == y["value"].cast("string"), "full" if both else "left")
    f, g = zero(F.col("f")), zero(F.col("g"))
    return j.agg((F.coalesce(F.sum(F.least(f, g)), F.lit(0)) / F.sum(F.greatest(f, g))).alias("shared"))


def predicate_support(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    """Pairs with equal values: sum of the products of frequencies."""
    x, y = histogram(a, ca).withColumnRenamed("n", "f"), histogram(b, cb).withColumnRenamed("n", "g")
    return x.join(y, "value").agg(F.coalesce(F.sum(F.col("f").cast("decimal(38,0)") * F.col("g")), F.lit(0)).cast("long").alias("support"))


def shared_cardinality(df: DataFrame, column: str) -> DataFrame:
    """``cardinality``: the ordered pairs of rows with equal present values of one column."""
    return histogram(df, column).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).cast("long").alias("cardinality"))


def moments(df: DataFrame, column: str) -> DataFrame:
    c = df[column].cast("double")
    return df.agg(F.avg(c).alias("average"), F.stddev_pop(c).alias("sigma"))


def frequent_constants(df: DataFrame, low: float, high: float, columns: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """``column_name, value, n``: present values of string columns with a share between ``low`` and ``high`` percent.

    One pass over the table: columns are unpivoted before the count.
    """
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    total = df.agg(F.count("*").alias("total"))
    tall = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), df[c].cast("string").alias("value")) for c in names])))
    counts = tall.where("value is not null and value <> ''").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    share = 100 * F.col("n") / F.col("total")
    keep = (share >= low) & (share <= high) if inclusive else (share > low) & (share < high)
    return counts.crossJoin(F.broadcast(total)).where(keep).select("column_name", "value", "n")  # one row


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_scaled`` in 0 to 1; what is no number is 0, and so is a constant column."""
    value = {c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)) for c in columns}
    bounds = df.agg(*[f(value[c]).alias(f"{c}__{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    wide = df.crossJoin(F.broadcast(bounds))  # one row
    scaled = {f"{c}_scaled": F.when(F.col(f"{c}__hi") > F.col(f"{c}__lo"), (value[c] - F.col(f"{c}__lo")) / (F.col(f"{c}__hi") - F.col(f"{c}__lo"))).otherwise(F.lit(0.0)) for c in columns}
    return wide.withColumns(scaled).drop(*bounds.columns)


def cluster_bounds(df: DataFrame, cluster: str, column: str) -> DataFrame:
    """Least and greatest value of each cluster, cut to whole numbers."""
    return df.groupBy(cluster).agg(F.min(column).cast("long").alias("low"), F.max(column).cast("long").alias("high"))


def kmeans_constants(df: DataFrame, column: str, k: int, seed: int = 1) -> DataFrame:
    """Interval bounds of a numeric column by k-means on its scaled values."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    scaled = min_max_scaled(df.select(column), [column])
    ready = VectorAssembler(inputCols=[f"{column}_scaled"], outputCol="features").transform(scaled)
    return cluster_bounds(KMeans(k=k, seed=seed).fit(ready).transform(ready), "prediction", column)


def thinned(values: Column, width_percent: float) -> Column:
    """Of an array of numbers, ascending, those that lie over ``width`` percent of the range beyond the one kept before."""
    s = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    step = (F.array_max(s) - F.array_min(s)) * (width_percent / 100)
    return F.aggregate(s, F.array().cast("array<double>"), lambda out, x: F.when((F.size(out) == 0) | (x > F.coalesce(F.get(out, F.size(out) - 1), x) + step), F.array_append(out, x)).otherwise(out))


def null_pattern(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` with a 0/1 column ``null_<c>`` each."""
    return df.withColumns({f"null_{c}": F.when(normal_null(df, c).isNull(), 1).otherwise(0) for c in columns or df.columns})


def null_pattern_clusters(df: DataFrame, k: int, columns: list[str] | None = None, seed: int = 1) -> DataFrame:
    """``df`` with the k-means cluster of its null pattern."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    marked = null_pattern(df, columns)
    names = [f"null_{c}" for c in columns or df.columns]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(marked)
    return KMeans(k=k, seed=seed).fit(ready).transform(ready).drop("features", *names)


# --- the predicate space ------------------------------------------------------------------


def joinable(tables: TableSet, t0: str, a: str, t1: str, b: str, threshold: float = 0.3) -> bool:
    """The same column, or columns of one kind in different tables that share over ``threshold`` of their values."""
    if t0 == t1:
        return a == b
    if tables.kind(t0, a) != tables.kind(t1, b) or tables.kind(t0, a) == "other":
        return False
    return (shared_ratio(tables.table(t0), a, tables.table(t1), b).first()[0] or 0) > threshold


def comparable(tables: TableSet, t0: str, a: str, t1: str, b: str, threshold: float = 0.3) -> bool:
    """Numeric columns whose averages and sigmas are both within ``threshold`` of each other."""
    if "numeric" != tables.kind(t0, a) or "numeric" != tables.kind(t1, b):
        return False
    x, y = moments(tables.table(t0), a).first(), moments(tables.table(t1), b).first()
    ratio = lambda p, q: 1.0 if p == q else min(p, q) / max(p, q) if p and q and p * q > 0 else 0.0
    return ratio(x[0], y[0]) > threshold and ratio(x[1], y[1]) > threshold


def equality_space(tables: TableSet, threshold: float = 0.3) -> list[Predicate]:
    """``t0.A == t1.B`` for every joinable pair of columns; shared values of all table pairs are counted in one job."""
    out = [Predicate(Operand(t, 0, c), "==", Operand(t, 1, c)) for t in tables.tables for c in tables.columns(t)]
    names, plans, at = sorted(tables.tables), None, []
    for i, t0 in enumerate(names):
        for t1 in names[i + 1 :]:
            for a in tables.columns(t0):
                for b in tables.columns(t1):
                    if tables.kind(t0, a) == tables.kind(t1, b) != "other":
                        one = shared_ratio(tables.table(t0), a, tables.table(t1), b).select(F.lit(len(at)).alias("i"), "shared")
                        plans = one if plans is None else plans.union(one)
                        at.append((t0, a, t1, b))
    if plans is not None:
        for r in plans.collect():  # one number a pair of columns
            if (r["shared"] or 0) > threshold:
                t0, a, t1, b = at[r["i"]]
                out.append(Predicate(Operand(t0, 0, a), "==", Operand(t1, 1, b)))
    return out


def constant_space(tables: TableSet, low: float, high: float, blank: bool = False) -> list[tuple[Predicate, int]]:
    """``t0.A == c`` and ``t1.A == c`` for frequent constants, with their frequency."""
    from ..functions.strings import is_blank_or_punctuation

    out = []
    for t in sorted(tables.tables):
        df = tables.table(t)
        if not any(isinstance(f.dataType, T.StringType) for f in df.schema.fields):
            continue
        found = frequent_constants(df, low, high)
        if not blank:
            found = found.where(~is_blank_or_punctuation(F.col("value")))
        for r in found.orderBy("column_name", "value").collect():  # at most 100 / low values a column
            out += [(Predicate(Operand(t, v, r["column_name"]), "==", constant=r["value"]), r["n"]) for v in (0, 1)]
    return out


def only_equal(space: list[Predicate]) -> list[Predicate]:
    return [p for p in space if p.op == "==" or p.is_ml]


def frequent_enough(tables: TableSet, space: list[Predicate], frequency: dict[Predicate, int], sigma: float, largest: int) -> list[Predicate]:
    """Drops predicates that can't reach ``sigma``: by frequency times the largest table, or by their pair count."""
    equal = [p for p in space if not p.is_constant and not p.is_ml]
    plans = None
    for i, p in enumerate(equal):
        one = predicate_support(tables.table(p.left.table), p.left.column, tables.table(p.right.table), p.right.column).select(F.lit(i).alias("i"), "support")
        plans = one if plans is None else plans.union(one)
    pairs = {equal[r["i"]]: r["support"] for r in plans.collect()} if plans is not None else {}
    return [p for p in space if p.is_ml or (frequency.get(p, 0) * largest if p.is_constant else pairs[p]) >= sigma]


def without_keys(tables: TableSet, space: list[Predicate], rows: dict[str, int], share: float = 0.8) -> list[Predicate]:
    """Drops equalities on columns that are nearly keys (distinct values over ``share`` of the rows)."""
    wanted = {(o.table, o.column) for p in space if not p.is_constant for o in (p.left, p.right)}
    plans = None
    for t, c in sorted(wanted):
        one = histogram(tables.table(t), c).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), F.lit(c).alias("c"), "n")
        plans = one if plans is None else plans.union(one)
    distinct = {(r["t"], r["c"]): r["n"] for r in plans.collect()} if plans is not None else {}
    near = {k for k, n in distinct.items() if n > share * rows[k[0]]}
    return [p for p in space if p.is_constant or not any((o.table, o.column) in near for o in (p.left, p.right))]


def without_small_domains(space: list[Predicate], repeated: dict[tuple[str, str], int], least: int) -> list[Predicate]:
    """Drops constants of columns with no more than ``least`` values of frequency over one."""
    return [p for p in space if not p.is_constant or repeated.get((p.left.table, p.left.column), 0) > least]


def without_cross(space: list[Predicate]) -> list[Predicate]:
    return [p for p in space if p.is_constant or p.left.table == p.right.table]


def consequences(space: list[Predicate]) -> list[Predicate]:
    """Everything but constants on t1."""
    return [p for p in space if not (p.is_constant and p.left.variable == 1)]
