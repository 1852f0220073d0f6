"""Comparing a query's rows with DuckDB's for its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return bytes(v) if isinstance(v, bytearray) else v


def same_rows(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = sorted(repr([cell(r[c]) for c in names]) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    assert got == sorted(repr([cell(r[i]) for i in at]) for r in want.fetchall()), sql
