"""Foreign-key joins, multi-variable joins, coverage and similarity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ForeignKey, TableSet

#: A side is broadcast only if it has at most so many rows and bytes (as text); else the join shuffles.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if a look at no more than ``rows`` rows shows that it is small."""
    n, found = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()
    return F.broadcast(df) if n <= rows and (found or 0) <= size else df


def prefixed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{name}__{c}") for c in df.columns])


def join_paths(keys: list[ForeignKey], length: int = 3) -> list[list[ForeignKey]]:
    """Every chain of up to ``length`` foreign keys that visits no table twice."""
    out: list[list[ForeignKey]] = []

    def grow(path: list[ForeignKey], seen: set[str]) -> None:
        if path:
            out.append(path)
        if len(path) < length:
            for k in keys:
                if (not path or k.table == path[-1].to_table) and k.to_table not in seen and (path or k.table not in seen):
                    grow([*path, k], seen | {k.table, k.to_table})

    grow([], set())
    return out


def chain_sql(path: list[ForeignKey], columns: dict[str, list[str]], drop_useless: set[str] = frozenset()) -> str:
    """Spark SQL for a chain: full outer joins, left outer where the right table's unmatched rows are useless."""
    names = [path[0].table, *(k.to_table for k in path)]
    picked = ", ".join(f"{t}.{c} AS {t}__{c}" for t in names for c in columns[t])
    sql = f"SELECT {picked} FROM {names[0]}"
    for k in path:
        kind = "LEFT OUTER" if k.to_table in drop_useless else "FULL OUTER"
        sql += f" {kind} JOIN {k.to_table} ON {k.table}.{k.column} = {k.to_table}.{k.to_column}"
    return sql


def fk_chain(tables: TableSet, path: list[ForeignKey]) -> DataFrame:
    """A chain as a DataFrame with columns ``table__column``."""
    out = prefixed(tables.table(path[0].table), path[0].table)
    for k in path:
        right = prefixed(tables.table(k.to_table), k.to_table)
        kind = "left_outer" if k.to_table in tables.drop_useless else "full_outer"
        out = out.join(right, out[f"{k.table}__{k.column}"] == right[f"{k.to_table}__{k.to_column}"], kind)
    return out


def fk_ids(tables: TableSet, key: ForeignKey, id0: str, id1: str) -> DataFrame:
    """The pairs of row identifiers that a foreign key joins."""
    a, b = tables.table(key.table), tables.table(key.to_table)
    return a.join(b, a[key.column] == b[key.to_column]).select(a[id0].alias("tid0"), b[id1].alias("tid1"))


def fk_groups(tables: TableSet, key: ForeignKey, id0: str, id1: str) -> DataFrame:
    """Each referred row with the rows that refer to it."""
    return fk_ids(tables, key, id0, id1).groupBy("tid1").agg(F.array_sort(F.collect_list("tid0")).alias("tids"))


def joinable_tables(tables: TableSet) -> list[tuple[str, str]]:
    return sorted({(k.table, k.to_table) for k in tables.keys})


def labelled_rows(df: DataFrame, ids: DataFrame, key: str = "row_id", keep: str = "left_semi") -> DataFrame:
    """The rows that labels name."""
    return df.join(ids.select(key).distinct() if keep != "left_semi" else ids.select(key), key, keep)


def multi_variable(tables: TableSet, predicates, variables: dict[int, str], ids: dict[int, str]) -> DataFrame:
    """Assignments of more than two tuple variables that satisfy all predicates, as ``t<i>`` identifiers.

    Variables are joined in the order in which predicates tie them to those before; Catalyst picks each join's strategy.
    """
    frames = {v: tables.table(t).select(*[F.col(c).alias(f"t{v}__{c}") for c in tables.columns(t)]) for v, t in variables.items()}
    name = lambda o: F.col(f"t{o.variable}__{o.column}")
    for p in predicates:
        if p.is_constant:
            frames[p.left.variable] = frames[p.left.variable].where(name(p.left).cast("string") == p.constant)
    order = [min(variables)]
    out = frames[order[0]]
    todo = [p for p in predicates if not p.is_constant]
    while len(order) < len(variables):
        ties = {v: [p for p in todo if {p.left.variable, p.right.variable} <= {*order, v} and v in (p.left.variable, p.right.variable)] for v in variables if v not in order}
        v = max(sorted(ties), key=lambda x: len(ties[x]))
        if not ties[v]:
            raise ValueError("a tuple variable is tied to no other")
        cond: Column = F.lit(True)
        for p in ties[v]:
            a, b = name(p.left), name(p.right)
            cond = cond & {"==": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[p.op]
        out = out.join(frames[v], cond)
        order.append(v)
    return out.select(*[F.col(f"t{v}__{ids[v]}").alias(f"t{v}") for v in sorted(variables)])


def inequality_count(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Pairs with ``t0.column < t1.column`` within groups, without the pairs: running counts of sorted values."""
    from pyspark.sql import Window

    by = by or []
    counts = df.dropna(subset=[column, *by]).groupBy(*by, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    return counts.withColumn("less", before * F.col("n")).groupBy(*by).agg(F.sum("less").cast("long").alias("pairs"))


def token_blocks(records: DataFrame, key: str, text: str, *, most: float = 0.1, shortest: int = 4) -> DataFrame:
    """Pairs ``l < r`` of records that share a token; short tokens and those in over ``most`` of the records are no keys."""
    n = records.agg(F.count("*").alias("total"))
    tokens = records.select(F.col(key).alias("id"), F.explode(F.array_distinct(F.split(F.lower(F.trim(text)), r"\s+"))).alias("token")).where(F.length("token") >= shortest)
    good = tokens.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where(F.col("df") <= most * F.col("total")).where("df > 1").select("token")  # one row
    kept = tokens.join(good, "token")
    return kept.select("token", F.col("id").alias("l")).join(kept.select("token", F.col("id").alias("r")), "token").where("l < r").select("l", "r").distinct()


def similarity_join(left: DataFrame, right: DataFrame, lkey: str, ltext: str, rkey: str, rtext: str, *, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """Pairs whose shingle sets have a Jaccard similarity of at least ``threshold``.

    Prefix filter instead of all pairs: sets in hash order must share one of their first
    ``n - ceil(threshold * n) + 1`` shingles; candidates are verified on the full sets.
    """
    from ..functions.strings import shingles

    def sets(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
        s = F.array_sort(F.transform(F.array_distinct(shingles(F.col(text), k)), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("s"))))
        return df.select(F.col(key).alias(name), s.alias("s")).where(F.size("s") > 0)

    a, b = sets(left, lkey, ltext, "l"), sets(right, rkey, rtext, "r")
    prefix = F.expr(f"slice(s, 1, cast(size(s) - ceil({threshold} * size(s)) + 1 as int)).h")
    met = a.select("l", F.explode(prefix).alias("h")).join(b.select("r", F.explode(prefix).alias("h")), "h").select("l", "r").distinct()
    both = met.join(a, "l").join(b.withColumnRenamed("s", "t"), "r")
    common = F.size(F.array_intersect("s", "t"))
    score = common / (F.size("s") + F.size("t") - common)
    return both.select("l", "r", score.alias("jaccard")).where(F.col("jaccard") >= threshold)


def similarity_classes(df: DataFrame, key: str, text: str, *, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows as ``key, fp`` (null for texts without a shingle) and their classes of equal shingle sets as ``fp, class_id, n, text``.

    A class goes by its least key.
    """
    from ..functions.strings import shingles

    found = F.array_sort(F.array_distinct(shingles(F.col(text), k)))
    # Shingles have one length, so their concatenation tells sets apart.
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.when(F.size(found) > 0, F.sha2(F.concat_ws("", found), 256)).alias("fp"))
    classes = rows.where("fp is not null").groupBy("fp").agg(F.min("key").alias("class_id"), F.count("*").alias("n"), F.min("text").alias("text"))
    return rows.select("key", "fp"), classes


def class_pairs(classes: DataFrame, *, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """``l, r, jaccard``: fingerprints of different classes that are similar enough, both ways round."""
    return similarity_join(classes, classes, "fp", "text", "fp", "text", k=k, threshold=threshold).where("l <> r")


def similarity_links(df: DataFrame, key: str, text: str, *, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """``key, class_id, links`` for every row: how many other rows are similar enough, without making the rows' pairs."""
    rows, classes = similarity_classes(df, key, text, k=k)
    others = class_pairs(classes, k=k, threshold=threshold).join(classes.select(F.col("fp").alias("r"), "n"), "r").groupBy(F.col("l").alias("fp")).agg(F.sum("n").alias("others"))
    counted = classes.join(others, "fp", "left").select("fp", "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return rows.join(counted, "fp", "left").select(F.col("key").alias(key), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def uncovered(pairs: DataFrame, covered: DataFrame) -> DataFrame:
    """Pairs that no chosen rule covers."""
    return pairs.join(covered, pairs.columns, "left_anti")
