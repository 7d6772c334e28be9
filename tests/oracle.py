"""Compares a Spark result with DuckDB's for the same tables, order-insensitively."""

import datetime
import decimal
import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str(v)
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime.date, pd.Timestamp)):
        return v.isoformat()[:19].replace("T00:00:00", "")
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


def same(spark_df, sql: str, sf_dir: str) -> None:
    got, want = spark_df.toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
