"""Holds queries against their SQL in DuckDB: columns, rows and values, whatever the order of rows."""

from __future__ import annotations

import datetime
import decimal
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("SONMAI_TESTDATA", "/root/testdata")


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def difference(spark, con, d: str, query, sql: str) -> str | None:
    """What differs, or None."""
    df = query(spark, d)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    if got == want:
        return None
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} rows and {len(want)}; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
