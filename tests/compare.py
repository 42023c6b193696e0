"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.10g}"
    return str(value)


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    lists = [[canonical(v) for v in frame[c].tolist()] for c in columns]
    return sorted(zip(*lists)) if lists else []


def difference(spark_df, connection, statement: str) -> str | None:
    """None when equal, else a short description."""
    got = spark_df.toPandas()
    want = connection.execute(statement).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}; e.g. {list(set(a) - set(b))[:2]} vs {list(set(b) - set(a))[:2]}"
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(wrong)} of {len(a)} rows differ; e.g. {wrong[:2]}"
    return None
