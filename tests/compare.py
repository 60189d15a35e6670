"""Holds a query's rows against its SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return "null" if v is None else str(v)


def differences(df, con, sql: str) -> list[str]:
    """What differs; nothing if columns and rows are equal."""
    got_columns = sorted(df.columns)
    found = con.execute(sql)
    want_columns = sorted(d[0] for d in found.description)
    if got_columns != want_columns:
        return [f"columns {got_columns} and {want_columns}"]
    names = [d[0] for d in found.description]
    place = [names.index(c) for c in got_columns]
    want = sorted(tuple(plain(r[i]) for i in place) for r in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in got_columns) for r in df.collect())
    if got == want:
        return []
    a, b = set(got) - set(want), set(want) - set(got)
    return [f"{len(got)} rows and {len(want)}", f"only in Spark: {sorted(a)[:2]}", f"only in SQL: {sorted(b)[:2]}"]
