"""Answer files: tolerant reading, submission, scored-run and prediction sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.sources.order import file_order, write_ordered_csv


def parse_answer(c: Column) -> Column:
    """'₹ 1,234' or 'INR 1234' -> number; anything unreadable is NULL."""
    return F.trim(F.regexp_replace(F.trim(c), ",|₹|INR", "")).try_cast("double")


ID_NAMES = ("question_id", "qid")


def tolerant_answers(rows: DataFrame, header: list[str] | None = None) -> DataFrame:
    """Rows (pos, cells ARRAY<STRING>) -> (qid, answer), the last row of a repeated id winning.

    ``header`` names the columns when the file has them; otherwise id and answer are the first two.
    """
    names = F.array(*[F.lit(h.strip().lower()) for h in header or []]).cast("array<string>")
    return _placed_answers(rows.withColumns(_columns_of(names)))


def _columns_of(names: Column) -> dict[str, Column]:
    """Where id and answer stand, from 1, under a header's lower-cased names; without any, the first two columns."""
    place = lambda n: F.nullif(F.array_position(names, n), F.lit(0)).cast("int")
    return {
        "id_at": F.coalesce(*[place(n) for n in ID_NAMES], F.lit(1)),
        "answer_at": F.coalesce(place("answer"), F.lit(2)),
    }


def _placed_answers(rows: DataFrame) -> DataFrame:
    cells = F.col("cells")
    return (
        rows.filter(F.size(cells) >= F.greatest("id_at", "answer_at"))
        .select(
            "pos",
            F.trim(F.try_element_at(cells, F.col("id_at"))).alias("qid"),
            parse_answer(F.try_element_at(cells, F.col("answer_at"))).alias("answer"),
        )
        .filter(F.col("qid") != "")
        .groupBy("qid")
        .agg(F.max_by("answer", "pos").alias("answer"))
    )


def csv_cells(line: Column | str) -> Column:
    """Cells of one line; quoted cells may hold commas, so a cell is a quoted run or a run without commas."""
    return F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)),
        lambda x: F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), '""', '"'),
    )


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer CSVs with or without a header line each, extra columns and stray spaces allowed.

    A header is the first line of a file that is not blank, if it names an id column; files may differ in it. Of
    repeated ids the last row wins, over several files the one in the last file by path.
    """
    lines = spark.read.text(path).select(file_order().alias("pos"), "value").filter(F.trim("value") != "")
    # One row a file.
    first = lines.groupBy("pos.file").agg(F.min(F.struct("pos", "value")).alias("first"))
    names = F.transform(csv_cells(F.col("first.value")), lambda x: F.lower(F.trim(x)))
    first = first.select("file", F.col("first.pos").alias("first_pos"), names.alias("names"))
    titled = F.arrays_overlap("names", F.array(*map(F.lit, ID_NAMES)))
    heads = first.filter(titled).select("file", "first_pos", *[c.alias(n) for n, c in _columns_of(F.col("names")).items()])
    rows = lines.withColumn("file", F.col("pos.file")).join(heads, "file", "left").filter(~F.col("pos").eqNullSafe(F.col("first_pos")))
    return _placed_answers(
        rows.select(
            "pos", csv_cells(F.col("value")).alias("cells"),
            F.coalesce("id_at", F.lit(1)).alias("id_at"), F.coalesce("answer_at", F.lit(2)).alias("answer_at"),
        )
    )


def write_submission(rows: DataFrame, path: str) -> None:
    """(pos, question_id, answer) -> a CSV in question order, in parts by name; unanswered stays empty."""
    write_ordered_csv(rows, path, [F.col("pos")], [F.col("question_id"), F.col("answer")])


def write_scored_run(report: DataFrame, path: str) -> None:
    """(question_id, answer, score to three places) ordered by id, in parts by name."""
    write_ordered_csv(
        report, path, [F.col("qid")],
        [F.col("qid").alias("question_id"), F.col("answered").alias("answer"), F.format_string("%.3f", F.col("score")).alias("score")],
    )


def prediction_rows(answers: DataFrame) -> DataFrame:
    """(uid, answer ARRAY<STRING>, scale) -> rows to store; failures hold one empty answer."""
    failed = F.col("answer").isNull()
    return answers.select(
        "uid",
        F.coalesce("answer", F.array(F.lit(""))).alias("answer"),
        F.when(failed, "").otherwise(F.coalesce("scale", F.lit(""))).alias("scale"),
    )


def write_predictions(answers: DataFrame, path: str) -> None:
    prediction_rows(answers).write.mode("overwrite").json(path)
