"""Run every registered query beside its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal

import duckdb

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in NAMES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else number
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def spark_rows(df):
    return normalised(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(db, sql):
    result = db.execute(sql)
    return normalised([d[0] for d in result.description], result.fetchall())


def same(left, right, tolerance=0.0) -> str:
    """Empty if both results agree, else the first difference."""
    (lc, lr), (rc, rr) = left, right
    if lc != rc:
        return f"columns {lc} != {rc}"
    if len(lr) != len(rr):
        return f"{len(lr)} rows != {len(rr)}"
    for a, b in zip(lr, rr):
        for name, x, y in zip(lc, a, b):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance:
                continue
            return f"{name}: {x!r} != {y!r} in {a} / {b}"
    return ""
