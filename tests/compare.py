"""Run a query and its SQL answer side by side and report the first difference."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def type_name(text: str) -> str:
    text = text.lower()
    names = {"int": "integer", "string": "varchar", "timestamp_ntz": "timestamp", "int128": "hugeint"}
    return names.get(text, text)


def normal(value):
    if isinstance(value, Decimal):
        return value.normalize() if value else Decimal(0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    found = con.sql(sql)
    ours = {name: type_name(kind) for name, kind in df.dtypes}
    theirs = {name: type_name(str(kind)) for name, kind in zip(found.columns, found.types)}
    if ours != theirs:
        return f"schemas differ: {sorted(set(ours.items()) ^ set(theirs.items()))}"
    left, right = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    if left != right:
        return (f"{sum(left.values())} rows against {sum(right.values())}; only here "
                f"{list((left - right).items())[:3]}, only there {list((right - left).items())[:3]}")
    return None
