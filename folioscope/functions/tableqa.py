"""Table-and-paragraph question helpers: formatting, arithmetic and answer shaping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscope.functions.text import as_col


def format_table(table: Column | str) -> Column:
    """ARRAY<ARRAY<STRING>> -> cells joined by ' | ', one row per line."""
    return F.array_join(
        F.transform(as_col(table), lambda row: F.array_join(F.transform(row, lambda x: F.coalesce(x, F.lit("None"))), " | ")),
        "\n",
    )


def format_paragraphs(paragraphs: Column | str) -> Column:
    """ARRAY<STRUCT<order,text>> -> texts in order (missing order first), one per line."""
    keyed = F.transform(
        as_col(paragraphs),
        lambda p, i: F.struct(F.coalesce(p["order"], F.lit(0)).alias("o"), i.alias("i"), p["text"].alias("text")),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda p: p["text"]), "\n")


def arithmetic(operands: Column | str, operation: Column | str) -> Column:
    """Apply a named operation to ARRAY<DOUBLE>; the first operand when it does not apply."""
    xs, op = as_col(operands), as_col(operation)
    first, second = F.try_element_at(xs, F.lit(1)), F.try_element_at(xs, F.lit(2))
    total = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    product = F.aggregate(xs, F.lit(1.0), lambda acc, x: acc * x)
    two = F.size(xs) >= 2
    divisible = two & (second != 0)
    return F.when(F.size(xs) > 0, F.when((op == "subtract") & two, first - second)
        .when((op == "percent_change") & divisible, F.bround(F.try_divide(first - second, second) * 100, 2))
        .when(op == "sum", total)
        .when(op == "average", F.bround(F.try_divide(total, F.size(xs)), 2))
        .when((op == "divide") & divisible, F.bround(F.try_divide(first, second), 4))
        .when(op == "multiply", product)
        .otherwise(first))


def _plain(value: Column) -> Column:
    """A double without an exponent, with one decimal place at least."""
    digits = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")
    written = value.cast("string")
    return F.when(written.contains("E"), F.coalesce(digits, written)).otherwise(written)


def answer_by_kind(kind: Column | str, spans: Column | str, operands: Column | str, operation: Column | str) -> Column:
    """count -> number of spans; span(s) -> the spans; arithmetic -> the computed value."""
    k = as_col(kind)
    listed = F.coalesce(as_col(spans), F.array().cast("array<string>"))
    value = arithmetic(operands, operation)
    return (
        F.when(k == "count", F.array(F.size(listed).cast("string")))
        .when(k.isin("span", "multi-span"), listed)
        .when((k == "arithmetic") & value.isNotNull(), F.array(_plain(value)))
    )
