"""Runs registered queries in Spark and their oracles in DuckDB and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (0, "") if isinstance(value, float) and math.isnan(value) else (2, f"{float(value) + 0.0:.6f}")
    if hasattr(value, "is_finite"):
        return (2, f"{float(value):.6f}")
    return (3, str(value))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in rows)


def spark_rows(frame):
    return normal(frame.columns, [tuple(r) for r in frame.collect()])


def oracle_rows(con, sql):
    found = con.execute(sql)
    return normal([d[0] for d in found.description], found.fetchall())


def difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"row counts {len(left[1])} != {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1], strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left[1])} rows differ, first {[v for _, v in wrong[0][0]]} != {[v for _, v in wrong[0][1]]}"
    return None
