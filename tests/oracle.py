"""Compares a query's rows with those of its SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return repr(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        return "nan" if x != x else repr(round(x, 9) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return f"{x.isoformat()}T00:00:00"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return repr(x)


def same_rows(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    assert got == want
    return len(got)
