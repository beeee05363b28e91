"""Compares a query with its SQL twin, value by value."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value) if hasattr(value, "isoformat") else value


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(df.columns)
    ours = sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=str)
    found = con.sql(sql)
    columns = found.columns
    assert sorted(columns) == names
    theirs = sorted((tuple(plain(dict(zip(columns, row, strict=True))[n]) for n in names) for row in found.fetchall()), key=str)
    assert ours == theirs
