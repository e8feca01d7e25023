"""Session factory and the handful of runtime settings the engine relies on."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession

from folioscope.scratch import Scratch, scratch

#: How many times its size a file counts.
FILE_FACTOR = 32

# Settings that only change how a plan is executed, never what it returns.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # A file's rows take many times its size in memory (dictionaries, runs): what the planner broadcasts by the size of
    # files has to be far smaller than its threshold. Larger sides are measured in their shuffle, uncompressed.
    "spark.sql.sources.fileCompressionFactor": str(FILE_FACTOR),
    # Adaptive plans describe themselves anew after every stage; the driver keeps what fits a screen or two.
    "spark.sql.maxPlanStringLength": "20000",
    # Shuffle files go at the end of the execution that wrote them, not when the driver collects garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # The JVM leaves methods above 8000 bytecodes uncompiled; such stages run faster without
    # whole-stage code, as compiled projections split into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "folioscope", master: str | None = None, cores: int = 8) -> SparkSession:
    """Create (or get) a session. ``master`` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "16g")
            .config("spark.sql.shuffle.partitions", str(cores))
        )
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: the session's spark.checkpoint.dir.

    Only a local run that names none gets a fresh folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = _local_folder()
    return folder


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def tables_of(spark: SparkSession) -> Scratch:
    """The session's intermediate tables in the shared folder."""
    return scratch(spark, shared_folder(spark))


def begin_query(spark: SparkSession) -> SparkSession:
    """Settings of a query, and an end to what the queries before it have left."""
    tables_of(tune(spark)).sweep(collect=True)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result as a table in the shared folder and read it back.

    Used where a result feeds several later steps. Unlike a cached copy it survives the loss of
    executors, and the written table's size lets the planner choose its joins. The table goes
    when no plan can read it any more (see :mod:`folioscope.scratch`).
    """
    return tables_of(df.sparkSession).write(df)


def release(*tables: DataFrame) -> None:
    """Delete results of :func:`cut_lineage` whose last reader has been written."""
    if tables:
        tables_of(tables[0].sparkSession).release(*tables)
