"""File discovery, the document index and tabular routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions.text import doc_id_from_path
from folioscope.operators.classify import classify_pages, header_class, index_class, tabular_class
from folioscope.sources.answers import csv_cells
from folioscope.sources.order import file_order


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below ``root`` at any depth: (path, length, doc_id). Contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length", doc_id_from_path("path").alias("doc_id"))
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Document index CSV -> (doc_id, filename, cls)."""
    rows = spark.read.csv(path, header=True)
    name = F.trim("filename")
    return rows.select(doc_id_from_path(name).alias("doc_id"), name.alias("filename"), index_class("doc_type").alias("cls"))


def locate_indexed(index: DataFrame, files: DataFrame) -> DataFrame:
    """Attach the real path: by the listed relative name, else by the bare file name."""
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    by_base = files.groupBy(base.alias("base")).agg(F.min("path").alias("base_path"))
    listed = index.withColumn("base", F.regexp_extract("filename", r"([^/]+)$", 1))
    by_name = listed.join(files.select("path", base.alias("base")), "base").filter(
        F.col("path").endswith(F.concat(F.lit("/"), F.col("filename")))
    ).groupBy("filename").agg(F.min("path").alias("listed_path"))
    return (
        listed.join(by_name, "filename", "left")
        .join(by_base, "base", "left")
        .select("doc_id", "filename", "cls", F.coalesce("listed_path", "base_path", "filename").alias("path"))
    )


def classify_documents(docs: DataFrame, index: DataFrame | None = None, page1: str = "page1") -> DataFrame:
    """(doc_id, cls): the index decides where there is one, the content otherwise."""
    by_content = classify_pages(docs.select("doc_id", page1), page1, "content_cls").select("doc_id", "content_cls")
    if index is None:
        return by_content.withColumnRenamed("content_cls", "cls")
    # Of several index lines for a document the one with the first class by name counts.
    listed = index.groupBy("doc_id").agg(F.min("cls").alias("cls"))
    return by_content.join(listed, "doc_id", "left").select("doc_id", F.coalesce("cls", "content_cls").alias("cls"))


def read_tabular(spark: SparkSession, path: str, sheet: str = "") -> tuple[str, DataFrame]:
    """A headed CSV or a Parquet table with its class; cells of a CSV stay text."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    return tabular_class(df.columns, sheet), df


def read_sheets(spark: SparkSession, root: str, pattern: str = "*.csv") -> dict[str, DataFrame]:
    """All headed CSVs below ``root`` by class: {class: rows}, cells as text.

    The first line of each file that is not blank decides its class. Files of one header line are parsed together; sheets
    of a class whose columns differ are united by name. Files of no known class give no rows. Of repeated column
    names the first counts.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    lines = found.select(file_order().alias("pos"), "value").filter(F.trim("value") != "").withColumn("file", F.col("pos.file"))
    first = lines.groupBy("file").agg(F.min(F.struct("pos", "value")).alias("first"))
    heads = first.select("file", F.col("first.pos").alias("first_pos"), F.col("first.value").alias("header"))
    heads = heads.withColumn("cls", header_class("header")).filter(F.col("cls") != "unknown")
    rows = lines.join(heads, "file").filter(F.col("pos") != F.col("first_pos"))
    # One row for each layout of a known class.
    layouts = heads.groupBy("cls", "header").agg(F.transform(csv_cells(F.col("header")), F.trim).alias("names"))
    sheets: dict[str, DataFrame] = {}
    for layout in layouts.orderBy("cls", "header").collect():
        kind = ", ".join(f"c{i} string" for i in range(len(layout["names"])))
        cells = rows.filter(F.col("header") == layout["header"]).select(F.from_csv("value", kind).alias("c"))
        kept = {n: i for i, n in reversed(list(enumerate(layout["names"]))) if n}
        sheet = cells.select(*[F.col(f"c.c{i}").alias(n) for n, i in sorted(kept.items(), key=lambda x: x[1])])
        before = sheets.get(layout["cls"])
        sheets[layout["cls"]] = sheet if before is None else before.unionByName(sheet, allowMissingColumns=True)
    return sheets


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page texts (doc_id, page_no, text) from Parquet, or one text file per document."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("doc_id", "page_no", "text")
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return whole.select(
        doc_id_from_path("path").alias("doc_id"),
        # A form feed separates the pages of a text file.
        F.posexplode(F.split("value", "\f")).alias("pos", "text"),
    ).select("doc_id", (F.col("pos") + 1).alias("page_no"), "text")
