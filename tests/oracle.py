"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, (bool, type(None), str)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (int(value) if value.is_integer() else value)
    if isinstance(value, decimal.Decimal):
        return _plain(float(value)) if value % 1 else int(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """Human-readable differences; empty when columns, row count and values agree."""
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    expected = rows_of(expected_columns, result.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(spark_df.columns) != sorted(expected_columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(expected_columns)}"]
    if len(got) != len(expected):
        extra = [x for x in got if x not in set(expected)][:2]
        missing = [x for x in expected if x not in set(got)][:2]
        return [f"rows {len(got)} != {len(expected)}; extra {extra}; missing {missing}"]
    return [f"{g} != {e}" for g, e in zip(got, expected) if g != e][:5]
