"""Compare a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(
                f"CREATE VIEW {name[:-8]} AS "
                f"SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def _sort_key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=_sort_key)


def kinds(rows, width):
    return [
        sorted({type(r[i]).__name__ for r in rows if r[i] is not None})
        for i in range(width)
    ]


def compare(df, con, sql):
    """None when equal, else a short account of the difference."""
    names, ours = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    other_names, theirs = normal(
        [d[0] for d in cursor.description], cursor.fetchall())
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    if kinds(ours, len(names)) != kinds(theirs, len(names)):
        return f"types {kinds(ours, len(names))} != {kinds(theirs, len(names))}"
    for a, b in zip(ours, theirs):
        if a != b and not (any(isinstance(v, float) and math.isnan(v) for v in a)):
            return f"{dict(zip(names, a))} != {dict(zip(names, b))}"
    return None
