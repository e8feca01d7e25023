"""What the vector operators share: usable rows, a bounded sample, exact neighbours of a few audit rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part: not null, not zero, all components finite.

    Of several lengths only the most common one takes part (the smaller of equals). Rows without an id don't.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null").where(finite & F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows.where(F.size("embedding") == (lengths["length"] if lengths else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def sample(rows: DataFrame, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``size`` rows with the smallest seeded hashes of their ids, on the driver."""
    got = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(size).collect()
    ids = np.array([r["vec_id"] for r in got], np.int64)
    return ids, np.array([r["embedding"] for r in got], np.float64).reshape(len(ids), -1)


def against_all(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(ids, matrix)`` over blocks of all rows; gives a record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch.column("vec_id").to_numpy(), matrix(batch.column("embedding")))

    return rows.select("vec_id", "embedding").mapInArrow(run, schema)
