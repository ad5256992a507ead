"""Runs a query and its DuckDB SQL over the same tables and compares all values."""

import glob
import os

import pandas as pd


def rows(frame):
    def cell(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return "-"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float) or type(x).__name__ in ("Decimal", "float64", "float32"):
            x = round(float(x), 6)
            return str(int(x)) if x.is_integer() else repr(x)  # a column with nulls may come as floats
        return str(x)

    names = sorted(frame.columns)
    return names, sorted(map(str, ([cell(x) for x in r] for r in frame[names].astype(object).values.tolist())))


def agree(spark, query, sql, folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, want = rows(query(spark, folder).toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
