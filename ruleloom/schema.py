"""Tables, their columns and foreign keys, and what counts as null."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` refers to ``to_table.to_column``."""

    table: str
    column: str
    to_table: str
    to_column: str


@dataclass
class TableSet:
    """Named tables with the columns that take part and their foreign keys."""

    tables: dict[str, DataFrame]
    skip: dict[str, set[str]] = field(default_factory=dict)
    keys: list[ForeignKey] = field(default_factory=list)
    drop_useless: set[str] = field(default_factory=set)

    def table(self, name: str) -> DataFrame:
        """A table without its skipped columns."""
        df = self.tables[name]
        return df.select(*self.columns(name)) if self.skip.get(name) else df

    def columns(self, name: str) -> list[str]:
        return [c for c in self.tables[name].columns if c not in self.skip.get(name, set())]

    def kind(self, table: str, column: str) -> str:
        """``string``, ``numeric`` or ``other``."""
        t = self.tables[table].schema[column].dataType
        return "string" if isinstance(t, T.StringType) else "numeric" if isinstance(t, NUMERIC) else "other"

    def rows(self) -> dict[str, int]:
        """Row counts, in one job."""
        counts = None
        for name, df in self.tables.items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
            counts = one if counts is None else counts.union(one)
        return {r["t"]: r["n"] for r in counts.collect()}  # one row a table

    def register(self) -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)


def normal_null(df: DataFrame, column: str) -> Column:
    """A key's value with '' as null; no trimming."""
    c = df[column]
    return F.nullif(c, F.lit("")) if isinstance(df.schema[column].dataType, T.StringType) else c


def present(df: DataFrame, column: str) -> Column:
    return normal_null(df, column).isNotNull()


def narrow_types(df: DataFrame) -> dict[str, str]:
    """The narrowest of ``long``, ``double`` and ``string`` for each string column, in one pass.

    Empty values don't count; a column without values is ``string``.
    """
    names = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not names:
        return {}
    value = {c: F.nullif(F.trim(df[c]), F.lit("")) for c in names}
    checks = []
    for c in names:
        checks += [F.count(value[c]).alias(f"{c}|n"), F.count(F.expr(f"try_cast(nullif(trim(`{c}`), '') as bigint)")).alias(f"{c}|l"), F.count(F.expr(f"try_cast(nullif(trim(`{c}`), '') as double)")).alias(f"{c}|d")]
    r = df.agg(*checks).first()
    return {c: "string" if not r[f"{c}|n"] else "long" if r[f"{c}|l"] == r[f"{c}|n"] else "double" if r[f"{c}|d"] == r[f"{c}|n"] else "string" for c in names}


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(f"try_cast(nullif(trim(`{c}`), '') as {types[c]})").alias(c) if types.get(c, "string") != "string" else F.col(c) for c in df.columns])


def is_string_type(sql_type: str) -> bool:
    return sql_type.lower().split("(")[0].strip() in {"string", "varchar", "varchar20", "char", "text", "nvarchar", "clob"}


def is_number_type(sql_type: str) -> bool:
    return sql_type.lower().split("(")[0].strip() in {"int", "integer", "bigint", "smallint", "tinyint", "long", "float", "double", "decimal", "numeric", "real"}
