"""Compares a query with its SQL in DuckDB: rows, columns and values, in any order."""

from __future__ import annotations

import glob
import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb


def cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return None if math.isnan(f) else f"{f:.9g}"
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    return str(v)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        name = p.rsplit("/", 1)[1].removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return c


def difference(spark, folder: str, query, sql: str) -> str:
    """Empty if both give the same."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(cell(r[c]) for c in cols) for r in df.collect())
    with connect(folder) as c:
        rel = c.execute(sql)
        names = [x[0] for x in rel.description]
        if sorted(names) != cols:
            return f"columns {cols} and {sorted(names)}"
        at = [names.index(x) for x in cols]
        want = Counter(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
