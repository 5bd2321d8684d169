"""A Spark result against its SQL twin, in any order."""

import os

import duckdb
import pandas as pd


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


def cell(v):
    if v is None or not hasattr(v, "__len__") and pd.isna(v):
        return "null"
    return f"{float(v):.6f}" if not isinstance(v, (str, bool)) and hasattr(v, "__float__") and not hasattr(v, "__len__") else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def same(spark, sf, query, sql) -> None:
    got, want = query(spark, sf).toPandas(), connection(sf).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
