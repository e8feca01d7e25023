"""Rule cascades: document class, question shape and question flags. One CASE each, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions import fixed_values as fv, money
from folioscope.functions.text import any_phrase, as_col, years_in

SHAPES = [
    "absence", "referenced_share", "date_span", "distinct_count", "hop_aggregate",
    "avg_work_size", "mean_vs_median", "rank_value", "threshold_aggregate", "gap_to_threshold",
    "exclusion_aggregate", "temporal_chain", "billing_shortfall", "outstanding_balance",
    "collection_rate", "category_diff", "annual_diff",
]

OPENING_CHARS = 400


def classify_pages(docs: DataFrame, page1: str = "page1", out: str = "cls") -> DataFrame:
    """Add the class of each document by its first page; the page is lowered once."""
    lowered = docs.withColumn("_low", F.lower(page1)).withColumn("_open", F.substring("_low", 1, OPENING_CHARS))
    return lowered.withColumn(out, _document_class(F.col("_low"), F.col("_open"))).drop("_low", "_open")


def _document_class(text: Column, opening: Column) -> Column:
    """NULL text means the page was unreadable; a document's own heading can rule it out."""
    return (
        F.when(text.isNull(), "unreadable")
        .when(any_phrase(opening, ["checklist", "compliance", "tender", "dossier"]), "unknown")
        .when(F.contains(text, F.lit("pmp")), "personnel_certificate")
        .when(
            F.contains(text, F.lit("six sigma")) & F.contains(text, F.lit("black belt")),
            "personnel_certificate",
        )
        .when(any_phrase(text, ["curriculum vitae", "key personnel"]), "cv")
        .when(
            any_phrase(text, ["whomsoever", "letter of recommendation", "reference letter"]),
            "reference_letter",
        )
        .when(
            F.contains(text, F.lit("completion")) & F.contains(text, F.lit("certificate")),
            "completion_certificate_any",
        )
        .otherwise("unknown")
    )


def index_class(doc_type: Column | str) -> Column:
    """Class of an index entry: the two completion types are one class, others keep their name."""
    kind = F.trim(as_col(doc_type))
    return F.when(kind.isin(fv.COMPLETION_DOC_TYPES), "completion_certificate_any").otherwise(kind)


def class_histogram(docs: DataFrame, cls: str = "cls") -> DataFrame:
    return docs.groupBy(cls).agg(F.count("*").alias("n_docs")).orderBy(F.desc("n_docs"), cls)


def tabular_class(columns: list[str], sheet: str = "") -> str:
    """Route a tabular file by its header (known before any row is read)."""
    header = " ".join(c.lower() for c in columns)
    if "invoice no" in header and "outstanding" in header:
        return "receivables_ageing"
    if "asset id" in header or sheet.lower() == "plant register":
        return "plant_machinery_register"
    return "unknown"


def header_class(header: Column | str) -> Column:
    """:func:`tabular_class` of a header line, for many files at once; a line names no sheet."""
    low = F.lower(as_col(header))
    return (
        F.when(low.contains("invoice no") & low.contains("outstanding"), "receivables_ageing")
        .when(low.contains("asset id"), "plant_machinery_register")
        .otherwise("unknown")
    )


def credential_type(text: Column | str) -> Column:
    upper = F.upper(as_col(text))
    return (
        F.when(F.contains(upper, F.lit("SIX SIGMA")), fv.CREDENTIAL_SIX_SIGMA)
        .when(F.contains(upper, F.lit("PMP")), fv.CREDENTIAL_PMP)
        .otherwise(fv.CREDENTIAL_OTHER)
    )


def with_shape(df: DataFrame, question: str = "question", answer_type: str = "answer_type") -> DataFrame:
    """Add the question's ``shape``; text is lowered and its figures are read once."""
    staged = df.withColumn("_low", F.lower(question)).withColumns(
        {"_years": F.size(years_in("_low")), "_bar": money.threshold_rupees(question)}
    )
    shape = _question_shape(F.col("_low"), F.col(answer_type), F.col("_years"), F.col("_bar"))
    return staged.withColumn("shape", shape).drop("_low", "_years", "_bar")


def _question_shape(q: Column, kind: Column, n_years: Column, bar: Column) -> Column:
    """One of the 17 shapes; the first rule that holds wins, hop_aggregate otherwise."""

    def has(*phrases: str) -> Column:
        return any_phrase(q, list(phrases))

    def has_any(phrases: list[str]) -> Column:
        return any_phrase(q, phrases)

    # Terms count once each, and a longer term also counts the shorter one inside it.
    n_terms = sum((F.contains(q, F.lit(t)).cast("int") for t in fv.CATEGORY_TERMS), F.lit(0))
    balance = (
        has_any(fv.BALANCE_PHRASES)
        | (has("still outstanding") & has_any(fv.CHARGE_WORDS))
        | (has("currently due") & has_any(fv.CHARGE_WORDS))
    ) & ~has_any(fv.AWARD_WORDS)
    bar_wording = has_any(fv.BAR_PHRASES) | (has("line") & ~has("line item"))

    return (
        F.when(kind == "days", "date_span")
        .when((kind == "count") & has_any(fv.ABSENCE_WORDS), "absence")
        .when(kind == "count", "distinct_count")
        .when((kind == "percent") & has_any(fv.ENDORSEMENT_WORDS), "referenced_share")
        .when((kind == "percent") & has_any(fv.COLLECTION_WORDS), "collection_rate")
        .when(kind == "percent", "referenced_share")
        .when(has_any(fv.AFTER_PHRASES) & has_any(fv.AFTER_DATE_WORDS), "temporal_chain")
        .when(has_any(fv.EXCLUSION_PHRASES), "exclusion_aggregate")
        .when(has_any(fv.MEAN_WORDS) & has("median"), "mean_vs_median")
        .when(balance, "outstanding_balance")
        .when(n_years >= 2, "annual_diff")
        .when((n_terms >= 2) & ~has("median", "201", "202", "largest"), "category_diff")
        .when(
            (has_any(fv.SHORTFALL_PHRASES) & has_any(fv.SHORTFALL_OBJECTS)) | has_any(fv.SHORTFALL_ALONE),
            "billing_shortfall",
        )
        .when(has_any(fv.AVERAGE_SIZE_PHRASES), "avg_work_size")
        .when(has_any(fv.LARGEST_WORDS) & has_any(fv.RUNNER_UP_WORDS), "rank_value")
        .when(has_any(fv.TARGET_GAP_PHRASES), "gap_to_threshold")
        .when(
            bar_wording & has_any(fv.BAR_UNIT_WORDS) & (bar > 0),
            "threshold_aggregate",
        )
        .otherwise("hop_aggregate")
    )


# --- flags -----------------------------------------------------------------------------------

CURRENCY_FIGURE = r"(?i)\d+(\.\d+)?\s*cr\b|\blakh\b"

# Phrase flags are data: tag -> phrases.
PHRASE_TAGS = {
    "is_rollup": fv.ROLLUP_PHRASES,
    "is_difference": ["median", *fv.DIFFERENCE_PHRASES],
    "needs_all_rows": ["median", *fv.SECOND_LARGEST_PHRASES],
    "is_billing": fv.BILLING_PHRASES,
}


def tag(df: DataFrame, text: str, tags: dict[str, list[str]]) -> DataFrame:
    """Add one boolean column per tag: does the lower-cased text contain any of its phrases."""
    lowered = df.withColumn("_low", F.lower(text))
    return lowered.withColumns({name: any_phrase("_low", phrases) for name, phrases in tags.items()}).drop("_low")


def flag_questions(df: DataFrame, text: str = "question") -> DataFrame:
    """All question flags: phrase tags, currency unit, threshold gap and threshold direction."""
    words = {
        "_crore": ["crore"], "_direction": fv.DIRECTION_WORDS, "_credential": ["credential"], "_gap": fv.GAP_WORDS,
    }
    tagged = tag(df, text, PHRASE_TAGS | words).withColumn("has_currency_unit", F.col(text).rlike(CURRENCY_FIGURE))
    money_named = F.col("_crore") | F.col("has_currency_unit")
    gap = (F.col("_direction") | F.col("_credential")) & money_named & F.col("_gap")
    return (
        tagged.withColumn("is_threshold_gap", gap)
        .withColumn("is_threshold_direction", F.col("_direction") & money_named & ~F.col("is_threshold_gap"))
        .drop(*words)
    )


def scope_decision(df: DataFrame) -> DataFrame:
    """What a rollup runs over when other entities are named only as context.

    Needs ``is_rollup``, ``needs_all_rows`` and the resolved ``client``, ``engineer``,
    ``project``, ``cred_type``. ``scope`` is NULL when the named entities stay filters.
    """
    context = F.col("project").isNotNull() | F.col("cred_type").isNotNull()
    whole_scope = (F.col("is_rollup") & context) | F.col("needs_all_rows")
    return df.withColumns(
        {
            "scope": F.when(whole_scope, F.coalesce("client", "engineer")),
            "scope_kind": F.when(
                whole_scope,
                F.when(F.col("client").isNotNull(), "client").when(F.col("engineer").isNotNull(), "engineer"),
            ),
            "engineer_is_filter": F.col("engineer").isNotNull()
            & ~(whole_scope & (F.col("client").isNotNull() | F.col("engineer").isNotNull())),
        }
    )
