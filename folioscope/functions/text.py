"""Text functions as Column expressions (no Python UDFs)."""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, functions as F

from folioscope.functions import fixed_values as fv


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_phrase(text: Column | str, phrases: list[str]) -> Column:
    """True when the text contains any of the phrases.

    ``text`` is evaluated once per phrase, so pass a column, not an expression.
    """
    return reduce(lambda a, b: a | b, (F.contains(as_col(text), F.lit(p)) for p in phrases))


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def blank_to_null(c: Column | str) -> Column:
    """NULL, '' and the text 'nan' all mean missing."""
    return F.nullif(F.regexp_replace(F.trim(as_col(c)), "^(?i:nan)$", ""), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column | str) -> Column:
    """Unify dashes and the replacement character to an em dash, squeeze whitespace."""
    return collapse_spaces(F.translate(F.coalesce(as_col(c), F.lit("")), "�–", "——"))


def clean_client_name(c: Column | str) -> Column:
    """Drop bracketed remarks and repair the known cut-off spellings."""
    name = F.trim(F.regexp_replace(normalize_text(c), r"\s*\([^)]*\)", ""))
    for cut_off, full in fv.CLIENT_CORRECTIONS.items():
        name = F.regexp_replace(name, "^" + re.escape(cut_off) + "$", full)
    return name


def clean_category(c: Column | str) -> Column:
    words_only = F.regexp_replace(F.lower(F.coalesce(as_col(c), F.lit(""))), r"(?U)[^\w\s]", " ")
    return collapse_spaces(words_only)


def package_number(c: Column | str) -> Column:
    """First 'Pkg-N' (dash optional) in canonical spelling, NULL when there is none."""
    return F.concat(F.lit("Pkg-"), F.nullif(F.regexp_extract(as_col(c), r"(?i)Pkg-?(\d+)", 1), F.lit("")))


def package_mention(c: Column | str) -> Column:
    """A package as people write it in a question: 'pkg 12', 'Package-12'."""
    digits = F.regexp_extract(as_col(c), r"(?i)(?:pkg|package)[-\s]*(\d+)", 1)
    return F.concat(F.lit("Pkg-"), F.nullif(digits, F.lit("")))


def state_name(c: Column | str) -> Column:
    """First state of the fixed list (list order, not text order) named in the text."""
    text = F.lower(as_col(c))
    return F.coalesce(*[F.when(F.contains(text, F.lit(s.lower())), s) for s in fv.STATES])


def years_in(c: Column | str) -> Column:
    """Distinct years 2010-2029 named in the text, ascending."""
    found = F.regexp_extract_all(as_col(c), F.lit(r"\b(201\d|202\d)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def credential_id(c: Column | str) -> Column:
    found = F.regexp_extract(as_col(c), r"(?i)\b(PMI-\d+|6S-\d+)\b", 1)
    return F.nullif(F.upper(found), F.lit(""))


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit("[A-Za-z]+"), F.lit(0))


def stem(word: Column) -> Column:
    """Drop one trailing 's' of words longer than three letters."""
    return F.when((F.length(word) > 3) & word.endswith("s"), word.substr(F.lit(1), F.length(word) - 1)).otherwise(word)


def name_words(c: Column | str) -> Column:
    """Distinct lower-case stems, without stopwords and words of one or two letters."""
    # Only ASCII letters make words, so only they are lowered; runs of three and more are kept.
    low = F.translate(F.coalesce(as_col(c), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    kept = F.array_except(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0)), literal_array(fv.NAME_STOPWORDS))
    return F.array_distinct(F.transform(kept, stem))


def without_words(ws: Column, mask: Column) -> Column:
    return F.array_except(ws, F.coalesce(mask, F.array().cast("array<string>")))


def acronyms(c: Column | str) -> Column:
    """Initials of all words and of the significant words, for the whole name and each comma part."""
    skipped = literal_array([w for w in fv.NAME_STOPWORDS if w not in fv.ACRONYM_LETTER_WORDS])

    def initials(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.upper(w.substr(1, 1))), "")

    def both(part: Column) -> Column:
        ws = words(part)
        significant = F.filter(ws, lambda w: ~F.array_contains(skipped, F.lower(w)))
        return F.array(initials(ws), initials(significant))

    name = as_col(c)
    parts = F.concat(F.array(name), F.split(name, ","))
    return F.array_sort(
        F.array_distinct(F.filter(F.flatten(F.transform(parts, both)), lambda a: F.length(a) >= 2))
    )


def acronym_tokens(c: Column | str) -> Column:
    """Two to six letter words of a question that could be an acronym, upper-cased."""
    found = F.regexp_extract_all(as_col(c), F.lit(r"(?U)\b[A-Za-z]{2,6}\b"), F.lit(0))
    function_words = literal_array([w.upper() for w in fv.FUNCTION_WORDS])
    return F.array_except(F.array_distinct(F.transform(found, F.upper)), function_words)


def first_line(c: Column | str) -> Column:
    """First non-blank line (the letterhead), trimmed."""
    lines = F.transform(F.split(as_col(c), "\n"), lambda line: F.trim(line))
    return F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1))


def doc_id_from_path(c: Column | str) -> Column:
    base = F.regexp_extract(as_col(c), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def digits_or_zero(c: Column | str) -> Column:
    text = as_col(c).cast("string")
    return F.when(text.rlike(r"^\d+$"), F.coalesce(text.try_cast("int"), F.lit(0))).otherwise(0)


def first_name(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_col(c), r"(\S+)", 1))


def title_words(c: Column | str) -> Column:
    """Words of a work's title used to recognise it; repeated words stay repeated."""
    plain = F.regexp_replace(F.lower(as_col(c)), "[–-]", " ")
    return F.filter(
        F.split(F.trim(plain), r"\s+"),
        lambda w: (F.length(w) > 2) & ~w.isin("package", "pkg"),
    )
