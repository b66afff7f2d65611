"""Compare registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{round(value, 6):.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return f"{type(value).__name__}:{value}"


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


def compare(spark, connection, folder: str, query, sql: str) -> str | None:
    """None if both agree, else what differs."""
    df = query(spark, folder)
    mine = [tuple(r) for r in df.collect()]
    cursor = connection.execute(sql)
    names, theirs = [c[0] for c in cursor.description], cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, mine), rows(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    different = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(different)} of {len(a)} rows differ: {different[0]}" if different else None
