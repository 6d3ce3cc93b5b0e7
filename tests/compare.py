"""Run a registered query on Spark and its SQL twin on DuckDB and compare values row by row."""

from __future__ import annotations

import glob
import os
import time

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _text(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if hasattr(value, "item"):
        value = value.item()
    return repr(value)


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_text(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark, sf_dir: str, run, sql: str, con) -> str:
    """Empty text when equal, else what differs."""
    t0 = time.time()
    got = run(spark, sf_dir).toPandas()
    t1 = time.time()
    want = con.execute(sql).df()
    t2 = time.time()
    compare.seconds = (t1 - t0, t2 - t1)
    compare.rows = len(got)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind}
    a, b = _rows(got), _rows(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} rows differ, kinds {kinds}, first: {str(diff[0])[:700]}"
    return f"kinds differ {kinds}" if kinds else ""
