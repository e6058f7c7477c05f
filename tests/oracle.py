"""Compare a Spark result with a DuckDB result, row by row after sorting."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = pathlib.Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    values = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(values, key=lambda r: [(v is None, str(v)) for v in r])


def differences(df, con: duckdb.DuckDBPyConnection, sql: str, tolerance: float = 0.0) -> list[str]:
    """Differences between ``df`` and ``sql``; empty when names, counts and all values agree."""
    spark_names, spark_rows = _sorted(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    sql_names, sql_rows = _sorted([c[0] for c in result.description], result.fetchall())
    if spark_names != sql_names:
        return [f"columns {spark_names} != {sql_names}"]
    if len(spark_rows) != len(sql_rows):
        return [f"{len(spark_rows)} rows != {len(sql_rows)}"]
    found = []
    for left, right in zip(spark_rows, sql_rows):
        for name, a, b in zip(spark_names, left, right):
            same = a == b
            if not same and isinstance(a, float) and isinstance(b, (int, float)):
                same = abs(a - b) <= tolerance
            if not same:
                found.append(f"{name}: {a!r} != {b!r} in {left}")
    return found
