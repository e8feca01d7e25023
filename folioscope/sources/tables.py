"""Table sinks, and the SQL surface: the tables as views plus two SQL-defined functions."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

SQL_FUNCTIONS = [
    "CREATE OR REPLACE TEMPORARY FUNCTION DAYS_BETWEEN(a STRING, b STRING) RETURNS INT RETURN "
    "coalesce(abs(datediff(try_cast(substr(b, 1, 10) AS DATE), try_cast(substr(a, 1, 10) AS DATE))), 0)",
    "CREATE OR REPLACE TEMPORARY FUNCTION PERCENT(n DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN "
    "coalesce(bround(try_divide(coalesce(n, 0) * 100, coalesce(d, 0)), 2), 0)",
]


def refresh_table(df: DataFrame, path: str) -> None:
    """Replace a table in full."""
    df.write.mode("overwrite").parquet(path)


def refresh_tables(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        refresh_table(df, f"{root}/{name}")


#: The file of a published table that names its version.
POINTER = "current.txt"


class RejectedTable(ValueError):
    """A new version failed its checks; the table is as it was."""


def publish_table(df: DataFrame, path: str, unique: Iterable[str] = (), required: Iterable[str] = ()) -> int:
    """Replace a table in one step, if the new rows pass their checks; returns the number of rows.

    The rows are written to a folder of their own. ``required`` columns hold no NULL, which is counted while they are
    written; no value of the ``unique`` columns repeats, which reads only these columns of what has been written. Then
    one atomic rename of the file :data:`POINTER` makes the new version current. Whoever reads the version before it
    goes on reading; versions older than that are deleted. One writer at a time.
    """
    spark, unique, required = df.sparkSession, list(unique), list(required)
    version, seen = f"v-{uuid.uuid4().hex}", Observation()
    missing = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(required)]
    df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *missing).write.parquet(f"{path}/{version}")
    wrong = [f"NULL in {c}" for i, c in enumerate(required) if seen.get[f"n{i}"]]
    if unique:
        keys = spark.read.parquet(f"{path}/{version}").groupBy(*unique).agg(F.count("*").alias("n_of_key"))
        if not keys.filter("n_of_key > 1").isEmpty():
            wrong.append(f"repeated {', '.join(unique)}")
    before = current_version(spark, path)
    if wrong:
        _drop(spark, path, version)
        raise RejectedTable("; ".join(wrong))
    _point(spark, path, version)
    for name in _versions(spark, path):
        if name not in (version, before):
            _drop(spark, path, name)
    return seen.get["n_rows"]


def published_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    version = current_version(spark, path)
    if version is None:
        raise ValueError(f"no table has been published at {path}")
    return spark.read.parquet(f"{path}/{version}")


def current_version(spark: SparkSession, path: str) -> str | None:
    store, _, place = _store(spark, f"{path}/{POINTER}")
    return spark.read.text(f"{path}/{POINTER}").first()["value"] if store.exists(place) else None


def _store(spark: SparkSession, path: str) -> tuple:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), conf, place


def _drop(spark: SparkSession, path: str, version: str) -> None:
    """Delete a version."""
    store, _, place = _store(spark, f"{path}/{version}")
    store.delete(place, True)


def _versions(spark: SparkSession, path: str) -> list[str]:
    store, _, place = _store(spark, path)
    return [n for n in (s.getPath().getName() for s in store.listStatus(place)) if n.startswith("v-")]


def _point(spark: SparkSession, path: str, version: str) -> None:
    store, conf, new = _store(spark, f"{path}/.{version}")
    out = store.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf)
    files.rename(store.makeQualified(new), store.makeQualified(_store(spark, f"{path}/{POINTER}")[2]), how)


def register_sql(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Make the tables and DAYS_BETWEEN / PERCENT available to spark.sql; MEDIAN is built in."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for statement in SQL_FUNCTIONS:
        spark.sql(statement)
