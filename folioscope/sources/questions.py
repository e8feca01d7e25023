"""Question sources: nested JSON and table-question documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.sources.order import file_order

_FIELDS = (
    "qid: string, question_id: string, question: string, question_text: string, "
    "answer_type: string, shape: string, hops: int, answer: double, answer_gold: double, "
    "reasoning_steps: array<string>, scored: boolean"
)
# A file is either one object holding a list, or the list itself (read as one row per question).
_FILE = f"questions array<struct<{_FIELDS}>>, answers array<struct<{_FIELDS}>>, " + _FIELDS.replace(":", "")
_TABLE_DOC = (
    "table struct<table: array<array<string>>>, paragraphs array<struct<order: int, text: string>>, "
    "questions array<struct<uid: string, question: string>>"
)


def read_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per question, ``pos`` being its place in the files, whichever of the accepted layouts they use.

    ``lines``: JSON Lines, each line in one of the layouts; such files are read by blocks, others whole.
    """
    raw = spark.read.schema(_FILE).json(path, multiLine=not lines)
    single = F.array(F.struct(*[F.col(f.split(":")[0]) for f in _FIELDS.split(", ")]))
    listed = F.when(F.size("questions") > 0, F.col("questions")).when(F.size("answers") > 0, F.col("answers"))
    rows = raw.select(file_order().alias("_place"), "*").select("_place", F.posexplode(F.coalesce(listed, single)).alias("_i", "q"))
    return rows.select(
        F.struct("_place", "_i").alias("pos"),
        F.coalesce("q.qid", "q.question_id").alias("qid"),
        F.coalesce("q.question", "q.question_text").alias("question"),
        "q.answer_type",
        "q.shape",
        "q.hops",
        F.coalesce("q.answer", "q.answer_gold").alias("answer"),
        "q.reasoning_steps",
        "q.scored",
    ).filter(F.col("qid").isNotNull())


def read_table_documents(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Table-question documents -> one row per question with its table and paragraphs.

    ``limit`` answers only the first questions in file order. ``lines``: one document a line, read by blocks.
    """
    docs = spark.read.schema(_TABLE_DOC).json(path, multiLine=not lines)
    rows = docs.select(file_order().alias("_place"), "*").select(
        "_place", F.col("table.table").alias("table"), "paragraphs", F.posexplode("questions").alias("_i", "q")
    )
    flat = rows.select(F.struct("_place", "_i").alias("pos"), "q.uid", "q.question", "table", "paragraphs")
    return flat.orderBy("pos").limit(limit) if limit else flat
