"""Runs a query on Spark and its SQL on DuckDB over one folder of tables and compares the rows as multisets."""

from __future__ import annotations

import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark, con, query, sql: str, sf_dir: str):
    """(columns match, rows only in Spark, rows only in SQL, rows)."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    theirs = rows(cols, cur.fetchall())
    return sorted(cols) == sorted(df.columns), ours - theirs, theirs - ours, sum(ours.values())
