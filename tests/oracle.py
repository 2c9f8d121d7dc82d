"""Compares a query with its oracle, row by row."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


def difference(df, con, sql: str) -> str | None:
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    names = rel.columns
    theirs = rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    if mine != theirs:
        a, b = [x for x in mine if x not in set(theirs)][:3], [x for x in theirs if x not in set(mine)][:3]
        return f"{len(mine)} and {len(theirs)} rows; only here {a}; only there {b}"
    return None
