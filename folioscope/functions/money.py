"""Money written the Indian way -> exact whole rupees, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioscope.functions import fixed_values as fv
from folioscope.functions.text import as_col, literal_map

# Fixed patterns. A minus counts as a sign only when no word character precedes it.
NUMBER = r"((?:(?<!\w)-)?\d[\d,]*+(?:\.\d++)?+|\.\d++)"
CRORE = r"(?i)" + NUMBER + r"\s*+Cr(?:ore)?s?\b"
LAKH = r"(?i)" + NUMBER + r"\s*+(?:Lakhs?|Lacs?)\b"
CURRENCY_OR_SPACE = r"(?i)\bRs\.?|INR|₹|\s+"
NOT_NUMERIC = r"(?!^-)[^\d.]"

_TENS_AND_UNITS = [w for w in fv.NUMBER_WORDS if w != "hundred"]
WORD_CRORE = (
    r"(?i)((?:" + "|".join(_TENS_AND_UNITS) + r")(?:[\s-](?:" + "|".join(fv.UNIT_WORDS) + r"))?)\s+crore"
)


def _decimal(text: Column) -> Column:
    # '' (no match) becomes NULL before the cast: a failing cast costs far more than a check.
    return F.nullif(F.replace(text, F.lit(","), F.lit("")), F.lit("")).try_cast("decimal(28,10)")


def _rupees(amount: Column) -> Column:
    return F.bround(amount, 0).try_cast("bigint")


def parse_money(c: Column | str) -> Column:
    """Crore, then lakh, then a plain number with any digit grouping; 0 when unreadable."""
    text = as_col(c)
    bare = F.regexp_replace(F.regexp_replace(text, CURRENCY_OR_SPACE, ""), NOT_NUMERIC, "")
    # The unit's letters are looked for first; most amounts name no unit.
    return F.coalesce(
        F.when(text.rlike("(?i)cr"), _rupees(_decimal(F.regexp_extract(text, CRORE, 1)) * F.lit(fv.RUPEES_PER_CRORE))),
        F.when(text.rlike("(?i)la"), _rupees(_decimal(F.regexp_extract(text, LAKH, 1)) * F.lit(fv.RUPEES_PER_LAKH))),
        _rupees(F.nullif(bare, F.lit("")).try_cast("decimal(28,10)")),
        F.lit(0).cast("bigint"),
    )


def money_from_number(c: Column | str) -> Column:
    """A numeric cell: half-even to whole rupees, missing or NaN -> 0, sign kept."""
    value = as_col(c).cast("double")
    return F.coalesce(F.when(~F.isnan(value), F.bround(value, 0)).cast("bigint"), F.lit(0).cast("bigint"))


def words_to_number(c: Column | str) -> Column:
    """'seventy-three' -> 73: the sum of the number words in the phrase."""
    table = literal_map(fv.NUMBER_WORDS)
    parts = F.split(F.lower(F.trim(as_col(c))), r"[\s-]+")
    return F.aggregate(
        parts, F.lit(0), lambda acc, w: acc + F.coalesce(F.element_at(table, w), F.lit(0))
    )


def threshold_rupees(c: Column | str) -> Column:
    """The bar named in a question: digits + crore, words + crore, digits + lakh, else 0."""
    text = as_col(c)
    # The unit's letters are looked for first; most questions name no unit.
    low = F.lower(text)
    in_crore, in_lakh = F.contains(low, F.lit("cr")), F.contains(low, F.lit("lakh"))
    crore = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*cr(?:ore)?s?\b", 1)
    spoken = F.nullif(words_to_number(F.regexp_extract(text, WORD_CRORE, 1)), F.lit(0))
    lakh = F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*lakhs?\b", 1)
    return F.coalesce(
        F.when(in_crore, _rupees(_decimal(crore) * F.lit(fv.RUPEES_PER_CRORE))),
        F.when(in_crore, spoken.cast("bigint") * F.lit(fv.RUPEES_PER_CRORE).cast("bigint")),
        F.when(in_lakh, _rupees(_decimal(lakh) * F.lit(fv.RUPEES_PER_LAKH))),
        F.lit(0).cast("bigint"),
    )


def indian_grouping(c: Column | str) -> Column:
    """Render a whole number as 33,38,00,000."""
    return F.regexp_replace(as_col(c).cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")
