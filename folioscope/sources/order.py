"""Place of a row in the files it was read from, and sinks whose parts keep an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

def file_order() -> Column:
    """(file, block, row): the order of rows over all files of a source; select it directly from the scan.

    Spark reads a block of a file from start to end in one task, so its running number rises inside the block. File and
    block don't depend on how blocks are packed into tasks; the number alone would.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def write_ordered_csv(rows: DataFrame, path: str, order: list[Column], columns: list[Column]) -> None:
    """One CSV in as many parts as the rows need: range partitions in ``order``, the header line in the first alone.

    The parts put together by name are the file. NULL and '' are written as nothing.
    """
    names = rows.select(*columns).columns
    body = rows.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_order"), F.struct(*columns).alias("_row"))
    cells = [F.col("_row").getField(n).cast("string").alias(n) for n in names]
    body = body.select(F.lit(1).alias("_part"), "_order", *cells)
    kind = body.schema["_order"].dataType.simpleString()
    titles = [F.lit(n).alias(n) for n in names]
    head = rows.sparkSession.range(1).select(F.lit(0).alias("_part"), F.lit(None).cast(kind).alias("_order"), *titles)
    lines = head.unionByName(body).orderBy("_part", "_order").select(*names)
    lines.write.mode("overwrite").csv(path, header=False, emptyValue="", nullValue="")
