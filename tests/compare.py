"""Running a query and its SQL on the same tables and comparing the rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def bag(columns, rows) -> tuple[tuple, Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = tuple(columns[i] for i in order)
    return names, Counter(tuple(plain(row[i]) for i in order) for row in rows)


def sql_rows(folder: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(folder, f"{name}.parquet").exists():
            con.execute(
                f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
            )
    found = con.execute(sql)
    return bag([c[0] for c in found.description], found.fetchall())


def spark_rows(frame):
    return bag(frame.columns, [tuple(row) for row in frame.collect()])


def differences(left: Counter, right: Counter, limit: int = 3) -> str:
    only_left, only_right = left - right, right - left
    return (
        f"{sum(only_left.values())} rows only from Spark: {list(only_left)[:limit]}\n"
        f"{sum(only_right.values())} rows only from SQL: {list(only_right)[:limit]}"
    )
