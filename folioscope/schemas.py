"""Table schemas (as DDL) and the raw -> typed conform step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.dates import parse_date
from folioscope.functions.money import parse_money
from folioscope.functions.text import clean_category, clean_client_name

WORKS = (
    "doc_id string, project_name string, client_name string, category string, "
    "raw_category string, value_inr bigint, completion_date date, lead_engineer string, "
    "lead_engineer_id string, package_no string, state string, client_cert_ref string, "
    "has_reference_letter boolean, ref_letter_doc_id string"
)
ENGINEERS = (
    "emp_id string, name string, designation string, business_unit string, "
    "experience_years string, qualification string, date_of_joining date"
)
CERTS = (
    "doc_id string, name string, emp_id string, cred_type string, cred_id string, "
    "issue_date date, valid_through date"
)
RECEIVABLES = (
    "invoice_no string, client_name string, raw_client_name string, invoice_date date, "
    "invoiced_inr bigint, status string, received_inr bigint, outstanding_inr bigint"
)
ASSETS = (
    "asset_id int, asset_type string, make string, acquired_year int, cost_inr bigint, "
    "condition string, location string, ownership string, safety_certified boolean"
)
CLIENTS = (
    "client_name string, total_projects_count bigint, total_awarded_inr bigint, "
    "referenced_projects_count bigint, unreferenced_projects_count bigint, "
    "total_invoiced_inr bigint, total_received_inr bigint, total_outstanding_inr bigint"
)
QUESTIONS = (
    "qid string, question string, answer_type string, shape string, hops int, answer double, "
    "reasoning_steps array<string>, scored boolean"
)


def fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ", 1)) for part in ddl.split(", ")]


def to_schema(df: DataFrame, ddl: str) -> DataFrame:
    """Select the schema's columns with its types; columns the input lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields(ddl)]
    )


def _raw_or(df: DataFrame, raw: str, typed: str, parsed: Column, default: Column) -> Column:
    """The parsed raw text when there is any, else the typed column, else the default."""
    fallback = F.coalesce(F.col(typed), default) if typed in df.columns else default
    if raw not in df.columns:
        return fallback
    return F.when(F.coalesce(F.col(raw), F.lit("")) != "", parsed).otherwise(fallback)


def conform_works(df: DataFrame) -> DataFrame:
    """Raw certificate fields -> the works schema; raw text wins over typed columns."""
    have = set(df.columns)
    zero, no_date = F.lit(0).cast("bigint"), F.lit(None).cast("date")
    columns = {
        "value_inr": _raw_or(df, "value_raw", "value_inr", parse_money("value_raw"), zero),
        "completion_date": _raw_or(
            df, "completion_date_raw", "completion_date", parse_date("completion_date_raw"), no_date
        ),
        "client_name": clean_client_name("client_name"),
        "project_name": F.coalesce(F.col("project_name"), F.lit("")),
    }
    if "category" in have:
        columns["raw_category"] = (
            F.coalesce("raw_category", "category") if "raw_category" in have else F.col("category")
        )
        columns["category"] = clean_category("category")
    if "has_reference_letter" not in have:
        columns["has_reference_letter"] = F.lit(False)
    return to_schema(df.withColumns(columns), WORKS)


def conform_certs(df: DataFrame) -> DataFrame:
    no_date = F.lit(None).cast("date")
    columns = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "cred_type", "cred_id")}
    columns["issue_date"] = _raw_or(df, "issue_date_raw", "issue_date", parse_date("issue_date_raw"), no_date)
    return to_schema(df.withColumns(columns), CERTS)


def conform_receivables(df: DataFrame) -> DataFrame:
    amounts = {
        c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")) if c in df.columns else F.lit(0).cast("bigint")
        for c in ("invoiced_inr", "received_inr", "outstanding_inr")
    }
    return to_schema(df.withColumns(amounts), RECEIVABLES)


def conform_engineers(df: DataFrame) -> DataFrame:
    return to_schema(df, ENGINEERS)
