"""Small helpers shared by the operators: bounded Arrow batches, missing columns, row hashes."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.session import FILE_FACTOR, tune

#: Characters of a word: everything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of variable-length data a Python step holds of its input at once, besides the row at hand.
BATCH_BYTES = 2 << 20

#: Settings for Arrow batches between the JVM and Python; they bound memory and change no result.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 * BATCH_BYTES),
    # Texts that a small set of ids selects are filtered before they are shuffled, from 64 MB of files on and by ids of up
    # to 256 MB; sizes of files count as many times as the session says.
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": f"{64 * FILE_FACTOR}m",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": f"{256 * FILE_FACTOR}m",
    # The driver writes the filter out about a hundred times, with every closure of the stages that use it: 256 KB of it.
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 21),
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Serve this package to the executors' Python, which may not have it on its path; once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), "folioscope.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def settings(spark: SparkSession) -> SparkSession:
    ship(tune(spark))
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(text: Column) -> Column:
    """64-bit key that tells rows with one doc_id but different texts apart; 0 for null."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most BATCH_BYTES in ``column``, one row at least."""
    for batch in batches:
        sizes = pyarrow.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > BATCH_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def slices(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in slices of about ``size`` bytes that end where no word of letters goes on."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and (text[end] >= 128 or chr(text[end]).isalpha()):
            end += 1
        yield text[at:end]
        at = end


def map_pieces(
    df: DataFrame, column: str, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """``fn()`` is called once a task and gives the function from one slice to its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for piece in pieces(batches, column):
            yield step(piece)
        pa.default_memory_pool().release_unused()  # the worker is kept for other tasks

    return df.mapInArrow(run, schema)
