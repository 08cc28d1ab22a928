"""Runs a query and its SQL side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([_value(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if rows and names match."""
    df = query(spark, sf_dir)
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if have[0] != want[0]:
        return f"columns {have[0]} and {want[0]}"
    if len(have[1]) != len(want[1]):
        return f"{len(have[1])} and {len(want[1])} rows"
    for a, b in zip(have[1], want[1], strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""
