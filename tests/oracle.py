"""Compare a Spark result with a DuckDB result as multisets of rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

from rowtide.registry.base import TABLES


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, Decimal):
        return ("dec", value.normalize())
    if isinstance(value, (bytearray, bytes)):
        return bytes(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


# How the two engines name the same type.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df, answer) -> list[str]:
    theirs = {d[0]: str(d[1]) for d in answer.description}
    found = []
    for name, kind in df.dtypes:
        want = SAME_TYPE.get(kind, kind.upper())
        if theirs[name].replace(" ", "") != want.replace(" ", ""):
            found.append(f"{name}: {kind} against {theirs[name]}")
    return found


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal, else what differs."""
    got = df.collect()
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    want = answer.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = type_differences(df, answer)
    if kinds:
        return f"types {kinds}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        return f"only spark {list((a - b).items())[:3]}, only sql {list((b - a).items())[:3]}"
    return None
