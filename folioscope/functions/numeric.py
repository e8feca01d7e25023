"""Shared numeric conventions: percentages, rounding by unit, half-even means."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscope.functions.text import as_col


def percent(numerator: Column | str, denominator: Column | str) -> Column:
    """100*n/d to two places, half-even; 0.0 when d is 0 or missing."""
    n = F.coalesce(as_col(numerator), F.lit(0)).cast("double")
    d = F.coalesce(as_col(denominator), F.lit(0)).cast("double")
    return F.coalesce(F.bround(F.try_divide(n * 100, d), 2), F.lit(0.0))


def whole(c: Column | str) -> Column:
    """Half-even to a whole number."""
    return F.bround(as_col(c), 0).cast("bigint")


def mean_whole(c: Column | str) -> Column:
    """Aggregate: half-even mean as a whole number."""
    return whole(F.avg(as_col(c)))
