"""Runs a query and its SQL on the same tables and compares the rows."""

import glob
import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return c


def plain(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, bool) or type(value).__name__.startswith("bool"):
        return str(bool(value))
    if isinstance(value, float) and value != int(value):
        return f"{value:.6g}"
    return str(int(value)) if isinstance(value, (int, float)) or type(value).__name__.startswith("int") else str(value)


def rows(p: pd.DataFrame) -> list[tuple]:
    columns = sorted(p.columns)
    return sorted(tuple(plain(None if v is pd.NA else v) for v in row) for row in p[columns].astype(object).itertuples(index=False))


def same(spark, name: str, query, sql: str, sf_dir: str = SMALL) -> None:
    mine, theirs = query(spark, sf_dir).toPandas(), views(sf_dir).execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns), name
    assert rows(mine) == rows(theirs), name
