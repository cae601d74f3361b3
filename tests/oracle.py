"""Compares registered queries with their DuckDB twins as the driver does."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return float(f"{value:.10g}")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value) if hasattr(value, "isoformat") else value


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[list[str], list[str]]:
    df = fn(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    return rows(df.columns, df.collect()), rows(names, want.fetchall())
