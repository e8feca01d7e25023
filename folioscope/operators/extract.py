"""Document text -> typed rows. Input is one row per page: (doc_id, page_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions import money, text as tx
from folioscope.functions.dates import parse_date
from folioscope.operators.classify import credential_type
from folioscope.schemas import ASSETS, CERTS, ENGINEERS, RECEIVABLES, to_schema

# --- fixed patterns: labels and wordings found in the documents --------------------------------

# A label on its own line; the value is the next line.
CERTIFICATE_LABELS = {
    "work": r"Name of Work|Project Name|Work",
    "category": r"Nature\s*/\s*Category|Work Category|Category",
    "value": r"Contract Value(?:\s*\(Original\))?|Executed Value",
    "completion": r"Completion Date|Completion",
    "lead": r"Contractor'?s Project Manager|Project Manager|Project Lead",
    "cert_ref": r"Client Certificate Ref",
    "client": r"Client",
}
INTERNAL_REF = r"(?:^|\n)\s*Internal Ref:\s*(\S+)"

QUOTE = "‘’“”'\"�"
PROSE_WORK = r"the work of\s+[" + QUOTE + r"]([^" + QUOTE + r"]+)[" + QUOTE + r"]\s*\(([^)]+)\)"
PROSE_VALUE = r"executed value of\s+([A-Za-z₹.]*\s*[\d,.]+\s*/-?)"
PROSE_COMPLETION = r"completed(?: in all respects)? on\s+([A-Za-z]+ \d{1,2},? \d{4}|\d{4}-\d{2}-\d{2})"
PROSE_LEAD = r"supervised on the contractor'?s side by\s+([A-Za-z\s]+?)\."

RESTATED_VALUE = [
    r"(?i)Contract Value\s*(?:\(Original\))?\s*\n?\s*(INR\s*[\d.,\s/-]+|Rs\.?\s*[\d.,\s/-]+)",
    r"(?i)Executed Value\s*\n?\s*(INR\s*[\d.,\s/-]+|Rs\.?\s*[\d.,\s/-]+)",
]
PLAIN_NUMBER = r"^\s*-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\s*$"
SAME_VALUE_RUPEES = 1000  # two figures this close are one value, rounded differently

CREDENTIAL_LAYOUTS = {
    "This is to certify that": {
        "name": r"This is to certify that\s*\n\s*([^\n]+)",
        "emp_id": r"Employee ID:\s*(EMP-\d+)",
        "cred_id": r"Credential ID:\s*(\S+)",
        "issued": r"Issued:\s*(\S+)",
        "valid": r"Valid Through\s*\n?\s*([^\n]+)",
    },
    "This credential is conferred upon": {
        "name": r"This credential is conferred upon\s*\n\s*([^\n]+)",
        "cred_id": r"Certificate No\.\s*\n\s*(\S+)",
        "issued": r"Issued\s*\n\s*([^\n]+)",
        "valid": r"Valid Through\s*\n\s*([^\n]+)",
    },
}
CV_FIELDS = {
    "name": r"Name\s+([^\n]+)",
    "emp_id": r"Employee ID\s+(EMP-\d+)",
    "designation": r"Designation\s+([^\n]+)",
    "business_unit": r"Business Unit\s+([^\n]+)",
    "experience_years": r"Total Experience\s+([^\n]+)",
    "qualification": r"Qualification\s+([^\n]+)",
    "date_of_joining": r"Date of Joining\s+([^\n]+)",
}


def find(text: Column | str, pattern: str, group: int = 1) -> Column:
    """First match, trimmed; NULL when there is none or it is blank."""
    return F.nullif(F.trim(F.regexp_extract(tx.as_col(text), pattern, group)), F.lit(""))


def labelled(text: Column | str, labels: str) -> Column:
    """Value on the line after any of the given label spellings."""
    return find(text, r"(?:^|\n)\s*(?:" + labels + r")\s*\n\s*([^\n]+)")


def document_texts(pages: DataFrame) -> DataFrame:
    """Pages -> one row per document with the header page and the full text in page order.

    The grouping is on the document, whose full text is one output value, so a group is never
    larger than a row of the result.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(
        F.min_by("text", "page_no").alias("page1"),
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("full_text"),
    )


def certificate_records(docs: DataFrame) -> DataFrame:
    """(doc_id, page1, full_text) -> usable work records, labelled layout first, prose otherwise."""
    page, full = F.col("page1"), F.col("full_text")
    field = {name: labelled(page, labels) for name, labels in CERTIFICATE_LABELS.items()}
    found = docs.select(
        "doc_id",
        "full_text",
        *[col.alias("l_" + name) for name, col in field.items()],
        find(page, INTERNAL_REF).alias("l_internal_ref"),
        tx.first_line(page).alias("letterhead"),
        find(full, PROSE_WORK, 1).alias("p_work"),
        find(full, PROSE_WORK, 2).alias("p_category"),
        find(full, PROSE_VALUE).alias("p_value"),
        find(full, PROSE_COMPLETION).alias("p_completion"),
        find(full, PROSE_LEAD).alias("p_lead"),
    )
    # The layout is chosen per record: labelled when it has both a work and a value.
    is_labelled = F.col("l_work").isNotNull() & F.col("l_value").isNotNull()

    def pick(name: str) -> Column:
        return F.when(is_labelled, F.col("l_" + name)).otherwise(F.col("p_" + name)).alias(name)

    raw = found.select(
        "doc_id",
        "full_text",
        F.coalesce("l_client", "letterhead").alias("client"),
        *[pick(n) for n in ("work", "category", "value", "completion", "lead")],
        F.when(is_labelled, F.col("l_cert_ref")).alias("cert_ref"),
        F.when(is_labelled, F.col("l_internal_ref")).alias("internal_ref"),
    )
    titled = raw.withColumns({"title": tx.normalize_text("work"), "restated": _restated_text("full_text")})
    typed = titled.select(
        "doc_id",
        F.coalesce(tx.package_number("title"), tx.package_number("full_text")).alias("package_no"),
        F.col("title").alias("project_name"),
        tx.clean_client_name("client").alias("client_name"),
        tx.clean_category("category").alias("category"),
        F.col("category").alias("raw_category"),
        money.parse_money("value").alias("stated_inr"),
        money.parse_money("restated").alias("restated_inr"),
        parse_date("completion").alias("completion_date"),
        tx.normalize_text("lead").alias("lead_engineer"),
        tx.state_name("title").alias("state"),
        F.col("cert_ref").alias("client_cert_ref"),
        "internal_ref",
        completeness("client", "category", "completion", "lead").alias("completeness"),
        (F.col("work").isNotNull() & F.col("value").isNotNull()).alias("has_fields"),
    )
    return usable_records(typed).select(
        "doc_id", "package_no", "project_name", "client_name", "category", "raw_category",
        refined_value("stated_inr", "restated_inr").alias("value_inr"),
        "completion_date", "lead_engineer", "state", "client_cert_ref", "internal_ref", "completeness",
    )


def _restated_text(full_text: Column | str) -> Column:
    """The value as spelled out again further down; the first wording that occurs decides."""
    return F.coalesce(*[find(full_text, p) for p in RESTATED_VALUE])


def refined_value(stated: Column | str, restated: Column | str) -> Column:
    """Prefer the restated figure when it is the same value written more exactly."""
    s, r = tx.as_col(stated), tx.as_col(restated)
    return F.when((r > 0) & (F.abs(r - s) < SAME_VALUE_RUPEES) & (r != s), r).otherwise(s)


def completeness(*fields: Column | str) -> Column:
    return sum((tx.blank_to_null(f).isNotNull().cast("int") for f in fields), F.lit(0))


def usable_records(typed: DataFrame) -> DataFrame:
    """Keep records with a work, a value, a package and a positive amount."""
    return typed.filter(F.col("has_fields") & F.col("package_no").isNotNull() & (F.col("stated_inr") > 0))


def credential_records(docs: DataFrame, page1: str = "page1") -> DataFrame:
    """Personnel certificates in either layout; the employee id exists in the first one only."""
    text = F.col(page1)

    def by_layout(name: str) -> Column:
        out = F
        for marker, patterns in CREDENTIAL_LAYOUTS.items():
            value = find(text, patterns[name]) if name in patterns else F.lit(None).cast("string")
            out = out.when(F.contains(text, F.lit(marker)), value)
        return out

    fields = ("name", "emp_id", "cred_id", "issued", "valid")
    found = docs.select("doc_id", credential_type(text).alias("cred_type"), *[by_layout(f).alias(f) for f in fields])
    dated = {"issue_date": parse_date("issued"), "valid_through": parse_date("valid")}
    return to_schema(found.withColumns(dated), CERTS)


def cv_records(docs: DataFrame, page1: str = "page1") -> DataFrame:
    found = docs.select("doc_id", *[find(page1, pattern).alias(name) for name, pattern in CV_FIELDS.items()])
    return to_schema(found.withColumn("date_of_joining", parse_date("date_of_joining")), ENGINEERS)


def letter_records(docs: DataFrame, page1: str = "page1") -> DataFrame:
    """Reference letters: the package named on the first page and the letterhead."""
    return docs.select(
        "doc_id",
        tx.package_number(page1).alias("package_no"),
        tx.first_line(page1).alias("client_name"),
    )


def conform_receivables_sheet(sheet: DataFrame) -> DataFrame:
    """Receivables rows with fixed headers -> typed; rows without invoice or client are skipped."""
    amounts = {
        "invoiced_inr": "Invoiced (INR)",
        "received_inr": "Received (INR)",
        "outstanding_inr": "Outstanding (INR)",
    }
    keyed = sheet.select(
        tx.blank_to_null("`Invoice No`").alias("invoice_no"),
        tx.blank_to_null("Client").alias("raw_client_name"),
        F.col("`Invoice Date`").cast("string").alias("dated"),
        F.trim("Status").alias("status"),
        *[F.col(f"`{header}`") for header in amounts.values()],
    ).filter(F.col("invoice_no").isNotNull() & F.col("raw_client_name").isNotNull())
    typed = keyed.select(
        "invoice_no",
        "raw_client_name",
        tx.blank_to_null(tx.clean_client_name("raw_client_name")).alias("client_name"),
        parse_date("dated").alias("invoice_date"),
        "status",
        *[amount_cell(keyed, header).alias(name) for name, header in amounts.items()],
    )
    return to_schema(typed.filter(F.col("client_name").isNotNull()), RECEIVABLES)


def conform_asset_sheet(sheet: DataFrame) -> DataFrame:
    """Plant register rows -> typed; rows without an integer id are skipped."""
    flag = F.lower(F.trim(F.col("`Safety Certified`").cast("string")))
    number = F.col("`Asset ID`").cast("string").try_cast("double")
    typed = sheet.select(
        F.when(~F.isnan(number), number.try_cast("int")).alias("asset_id"),
        F.trim("Type").alias("asset_type"),
        F.trim("Make").alias("make"),
        tx.digits_or_zero("Acquired").alias("acquired_year"),
        amount_cell(sheet, "Cost (INR)").alias("cost_inr"),
        F.trim("Condition").alias("condition"),
        F.trim("Location").alias("location"),
        F.trim("Ownership").alias("ownership"),
        F.coalesce(~flag.isin("", "0", "0.0", "false"), F.lit(False)).alias("safety_certified"),
    )
    return to_schema(typed.filter(F.col("asset_id").isNotNull()), ASSETS)


def amount_cell(sheet: DataFrame, header: str) -> Column:
    """A money cell: numbers keep their sign, text goes through the money parser."""
    cell = F.col(f"`{header}`")
    if sheet.schema[header].dataType.typeName() == "string":
        plain = cell.rlike(PLAIN_NUMBER)
        number = F.bround(F.trim(cell).try_cast("double"), 0).try_cast("bigint")
        return F.coalesce(F.when(plain, number), money.parse_money(cell))
    return money.money_from_number(cell)
