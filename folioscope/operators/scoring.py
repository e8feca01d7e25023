"""Scoring answers against a gold table, plausibility checks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.text import as_col

EXACT = 1e-6


def proportional_score(gold: Column | str, answer: Column | str) -> Column:
    """1 for exact, falling linearly with the relative error, never below 0; NULL answers 0."""
    g, a = as_col(gold).cast("double"), as_col(answer).cast("double")
    return F.coalesce(
        F.when(a.isNull() | g.isNull(), 0.0)
        .when(g == 0, F.when(a == 0, 1.0).otherwise(0.0))
        .otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - g) / F.abs(g))),
        F.lit(0.0),
    )


def band(score: Column | str) -> Column:
    s = as_col(score)
    return F.when(s > 0.98, "OK").when(s > 0.5, "CLOSE").otherwise("WRONG")


def scored_only(gold: DataFrame) -> DataFrame:
    """Drop questions marked as unscored; an absent mark means scored."""
    if "scored" not in gold.columns:
        return gold
    return gold.filter(F.coalesce("scored", F.lit(True)))


def question_report(gold: DataFrame, submitted: DataFrame) -> DataFrame:
    """(qid, shape, gold, answered, score, band); unanswered questions stay with score 0."""
    joined = scored_only(gold).join(submitted.select("qid", F.col("answer").alias("answered")), "qid", "left")
    score = proportional_score("gold", "answered")
    return joined.select("qid", "shape", "gold", "answered", score.alias("score"), band(score).alias("band"))


def score_by_shape(report: DataFrame) -> DataFrame:
    return (
        report.groupBy("shape")
        .agg(F.sum("score").alias("total"), F.count("*").alias("n"), F.avg("score").alias("mean"))
        .orderBy(F.desc("mean"), "shape")
    )


def score_totals(report: DataFrame) -> DataFrame:
    exact = F.abs(F.col("answered") - F.col("gold")) < EXACT
    return report.agg(
        F.count("answered").alias("answered"),
        F.count("*").alias("n"),
        F.sum("score").alias("total"),
        F.avg("score").alias("mean"),
        F.count_if(exact).alias("exact"),
    )


def implausible(answer: Column | str, answer_type: Column | str) -> Column:
    """Why a value cannot be an answer of its unit; NULL when it can."""
    v, kind = as_col(answer).cast("double"), as_col(answer_type)
    return (
        F.when(v.isNull(), "no value")
        .when((kind == "count") & (v > 1000), "count too large")
        .when((kind == "percent") & ((v < 0) | (v > 100)), "percent out of range")
        .when((kind == "days") & ((v < 0) | (v > 36500)), "days out of range")
    )


def implausible_loose(answer: Column | str, answer_type: Column | str, largest_table: Column) -> Column:
    """The lenient variant: counts are bounded by the largest table, others by magnitude only."""
    v, kind = as_col(answer).cast("double"), as_col(answer_type)
    return (
        F.when(v.isNull(), "no value")
        .when((kind == "count") & (v > largest_table), "count too large")
        .when((kind == "percent") & (F.abs(v) > 100000), "percent out of range")
        .when((kind == "days") & ((v < 0) | (v > 36500)), "days out of range")
        .when((kind == "money") & (F.abs(v) > 1e12), "money out of range")
    )
