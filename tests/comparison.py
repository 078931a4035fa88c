"""Compares a query with its SQL: column names, rows and values, whatever their order."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(x):
    if x is None or isinstance(x, (str, bool, int, bytes)):
        return x
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else x if math.isinf(x) else int(x) if x == int(x) and abs(x) < 1e15 else float(f"{x:.9g}")
    if isinstance(x, (datetime, date)):
        return str(x)
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    return tuple(plain(v) for v in x)


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """What differs, '' if nothing."""
    got = query(spark, sf_dir)
    a = rows_of(got.columns, got.collect())
    want = duck(sf_dir).execute(sql)
    names = [d[0] for d in want.description]
    b = rows_of(names, want.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} against {sorted(names)}"
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, as {str(wrong[0])[:600]}" if wrong else ""
