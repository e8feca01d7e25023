"""Date parsing and day arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscope.functions import fixed_values as fv
from folioscope.functions.text import as_col, literal_map

# Fixed layouts, day first: 2019-08-23, 23/08/2019, August 23, 2019, 23 August 2019.
YEAR_FIRST = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"
DAY_FIRST = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$"
MONTH_NAME_FIRST = r"^([A-Za-z]+)\s+(\d{1,2})(?:,\s*|\s+)(\d{4})$"
DAY_MONTH_NAME = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
INSIDE_YEAR_FIRST = r"(\d{4})[-/](\d{2})[-/](\d{2})"
INSIDE_DAY_FIRST = r"(\d{2})[-/](\d{2})[-/](\d{4})"
WRITTEN_DATE = r"\b([A-Za-z]+ \d{1,2},? \d{4}|\d{4}-\d{2}-\d{2}|\d{1,2} [A-Za-z]+ \d{4})\b"

MONTH_NUMBER = {name: i + 1 for i, name in enumerate(fv.MONTH_NAMES)} | {
    name[:3]: i + 1 for i, name in enumerate(fv.MONTH_NAMES)
}


def parse_date(c: Column | str) -> Column:
    """Text -> DATE; NULL when no layout fits or the day does not exist.

    The text is read by the first layout it has the form of, so most rows cost one or two
    patterns. It is referenced once per layout: pass a column, not an expression.
    """
    text = F.trim(as_col(c))
    months = literal_map({k: str(v) for k, v in MONTH_NUMBER.items()})
    month = F.element_at(months, F.lower(F.regexp_extract(text, "[A-Za-z]+", 0)))

    def rearranged(pattern: str, order: str) -> Column:
        return F.regexp_replace(text, pattern, order).try_cast("date")

    def named(pattern: str, year_and_day: str) -> Column:
        # 'year-?-day', the month name being looked up; an unknown name gives NULL.
        return F.replace(F.regexp_replace(text, pattern, year_and_day), F.lit("?"), month).try_cast("date")

    def embedded(pattern: str, y: int, m: int, d: int) -> Column:
        found = F.regexp_extract(text, pattern, 0)
        return F.concat_ws("-", *[F.regexp_extract(found, pattern, g) for g in (y, m, d)]).try_cast("date")

    return (
        F.when(text.rlike(YEAR_FIRST), rearranged(YEAR_FIRST, "$1-$3-$4"))
        .when(text.rlike(DAY_FIRST), rearranged(DAY_FIRST, "$4-$3-$1"))
        .when(text.rlike(MONTH_NAME_FIRST), named(MONTH_NAME_FIRST, "$3-?-$2"))
        .when(text.rlike(DAY_MONTH_NAME), named(DAY_MONTH_NAME, "$3-?-$1"))
        .otherwise(F.coalesce(embedded(INSIDE_YEAR_FIRST, 1, 2, 3), embedded(INSIDE_DAY_FIRST, 3, 2, 1)))
    )


def written_date(c: Column | str) -> Column:
    """Text of the first date written anywhere in a question, '' when there is none."""
    return F.regexp_extract(as_col(c), WRITTEN_DATE, 1)


def days_between(a: Column | str, b: Column | str) -> Column:
    """Absolute gap in days; a missing or unreadable side counts as 0."""
    def day(c: Column | str) -> Column:
        return as_col(c).cast("string").substr(1, 10).try_cast("date")

    return F.coalesce(F.abs(F.datediff(day(b), day(a))), F.lit(0))
