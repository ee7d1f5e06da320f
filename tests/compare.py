"""Compare a Spark result with its SQL statement run by DuckDB on the same files."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        return round(float(value), 9)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str, allow_empty: bool = False) -> str | None:
    """Null if both give the same rows, else what differs."""
    got_cols = df.columns
    got = _rows(got_cols, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_cols = [c[0] for c in result.description]
    want = _rows(want_cols, result.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} <> {sorted(want_cols)}"
    if not got and not allow_empty:
        return "no rows"
    if got != want:
        extra, lost = sorted(set(got) - set(want), key=repr)[:3], sorted(set(want) - set(got), key=repr)[:3]
        return f"{len(got)} rows, {len(want)} wanted; only ours {extra}; only theirs {lost}"
    return None
