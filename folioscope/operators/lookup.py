"""Joins against one-row-per-key tables that stay balanced and broadcast only what is small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Measured bytes of a table that may be broadcast. The driver holds it as rows, as a hash table and in blocks at once.
BROADCAST_BYTES = 8 * 1024 * 1024


def left_lookup(df: DataFrame, side: DataFrame, keys: list[str], spread: str = "qid") -> DataFrame:
    """Left join on ``keys``, the first of which is text; rows without it match nothing.

    A plain join hashes all rows with a missing key to one task. Here each of them gets a key of
    its own, so they spread like any others.
    """
    first, rest = keys[0], keys[1:]
    own = F.concat(F.lit("\0"), F.col(spread).cast("string"))
    left = df.withColumn("_k0", F.coalesce(F.col(first), own))
    right = side.withColumnRenamed(first, "_k0")
    for i, k in enumerate(rest, 1):
        left, right = left.withColumn(f"_k{i}", F.col(k)), right.withColumnRenamed(k, f"_k{i}")
    helpers = [f"_k{i}" for i in range(len(keys))]
    return left.join(right, helpers, "left").drop(*helpers)


def broadcast_checked(written: DataFrame) -> DataFrame:
    """Hint a broadcast when the measured size of a written table is within BROADCAST_BYTES.

    Larger tables are returned as they are and meet the other side in a shuffle join.
    """
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in written.columns), F.lit(0))
    size = written.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(written) if size <= BROADCAST_BYTES else written
