"""Comparison of a query's rows with those of its SQL twin in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    """A value in one form, whichever engine made it."""
    if x is None:
        return None
    if isinstance(x, float) and math.isnan(x):
        return "NaN"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def close(a, b) -> bool:
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if the rows are equal, else what differs first."""
    got = rows_of(df.columns, df.collect())
    con = duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want, strict=True):
        if not all(map(close, g, w)):
            return f"{g} != {w}"
    return ""
