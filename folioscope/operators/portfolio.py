"""Client, engineer and category aggregates: the facts every analytical shape is read from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.functions.numeric import percent, whole
from folioscope.functions.text import blank_to_null
from folioscope.operators.containment import contained_names
from folioscope.operators.ranking import exact_median, top_two_gap



NO_CATEGORY = "(none)"


def present(df: DataFrame, name: str):
    """Rows whose key is not missing; only text keys have blank spellings of missing."""
    is_text = df.schema[name].dataType.typeName() == "string"
    return (blank_to_null(name) if is_text else F.col(name)).isNotNull()


def client_works(works: DataFrame, client: str = "client_name", value: str = "value_inr", flag: str = "has_reference_letter") -> DataFrame:
    """Count, total and letter coverage per client."""
    return (
        works.filter(present(works, client))
        .groupBy(client)
        .agg(
            F.count("*").alias("n_works"),
            F.sum(value).alias("awarded"),
            F.count_if(F.col(flag)).alias("n_referenced"),
            F.count_if(~F.col(flag)).alias("n_unreferenced"),
            F.avg(value).alias("mean_value"),
        )
    )


def client_billing(receivables: DataFrame, client: str = "client_name") -> DataFrame:
    return (
        receivables.filter(present(receivables, client))
        .groupBy(client)
        .agg(
            F.sum("invoiced_inr").alias("invoiced"),
            F.sum("received_inr").alias("received"),
            F.sum("outstanding_inr").alias("outstanding"),
        )
    )


def client_rollup(works: DataFrame, receivables: DataFrame) -> DataFrame:
    """The clients table: each fact is aggregated first, then the two meet once per client."""
    w, r = client_works(works), client_billing(receivables)

    def number(name: str, alias: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(alias)

    return w.join(r, "client_name", "full_outer").select(
        "client_name",
        number("n_works", "total_projects_count"),
        number("awarded", "total_awarded_inr"),
        number("n_referenced", "referenced_projects_count"),
        number("n_unreferenced", "unreferenced_projects_count"),
        number("invoiced", "total_invoiced_inr"),
        number("received", "total_received_inr"),
        number("outstanding", "total_outstanding_inr"),
    )


def client_shapes(works: DataFrame, receivables: DataFrame) -> DataFrame:
    """Every shape that needs nothing but the client, one row per client, NULL where undefined."""
    base = client_works(works)
    medians = exact_median(works, ["client_name"], "value_inr").select("client_name", "median")
    gaps = top_two_gap(works, ["client_name"], "value_inr", "doc_id", "rank_gap")
    joined = (
        base.join(client_billing(receivables), "client_name", "full_outer")
        .join(medians, "client_name", "left")
        .join(gaps, "client_name", "left")
    )
    has_works = F.col("n_works") > 0
    awarded, invoiced = F.coalesce("awarded", F.lit(0)), F.coalesce("invoiced", F.lit(0))
    return joined.select(
        "client_name",
        F.coalesce("n_unreferenced", F.lit(0)).alias("absence"),
        F.when(has_works, percent("n_referenced", "n_works")).alias("referenced_share"),
        F.col("awarded").alias("client_total"),
        whole("mean_value").alias("avg_work_size"),
        whole(F.col("mean_value") - F.col("median")).alias("mean_vs_median"),
        F.col("rank_gap").alias("rank_value"),
        F.abs(awarded - invoiced).alias("billing_shortfall"),
        F.coalesce("outstanding", F.lit(0)).alias("outstanding_balance"),
        F.when(invoiced > 0, percent("received", "invoiced")).otherwise(0.0).alias("collection_rate"),
    )


def category_totals(works: DataFrame) -> DataFrame:
    """Σ value per (client, category); works without a category are kept under NO_CATEGORY."""
    named = F.when(present(works, "category"), F.col("category")).otherwise(NO_CATEGORY)
    return works.groupBy("client_name", named.alias("category")).agg(F.sum("value_inr").alias("category_total"))


def year_totals(works: DataFrame) -> DataFrame:
    return (
        works.filter(F.col("completion_date").isNotNull())
        .groupBy("client_name", F.year("completion_date").alias("year"))
        .agg(F.sum("value_inr").alias("year_total"))
    )


def exclusion_totals(works: DataFrame) -> DataFrame:
    """Σ over all other categories for every (client, category) of the portfolio."""
    per_category = category_totals(works)
    per_client = per_category.groupBy("client_name").agg(F.sum("category_total").alias("categorised_total"))
    return per_category.join(per_client, "client_name").select(
        "client_name", "category", (F.col("categorised_total") - F.col("category_total")).alias("exclusion_total")
    )


def engineer_shapes(works: DataFrame) -> DataFrame:
    """Distinct categories and total value per lead engineer.

    Distinct counting goes through (engineer, category) first, so it stays a partial aggregate.
    """
    return (
        works.filter(present(works, "lead_engineer"))
        .groupBy(F.col("lead_engineer").alias("engineer"), "category")
        .agg(F.sum("value_inr").alias("v"), F.count("*").alias("n"))
        .groupBy("engineer")
        .agg(
            F.count_if(blank_to_null("category").isNotNull()).alias("distinct_count"),
            F.sum("v").alias("engineer_total"),
            F.sum("n").alias("n_led"),
        )
    )


def first_issue(certs: DataFrame) -> DataFrame:
    """Earliest credential date per holder."""
    return (
        certs.filter(F.col("issue_date").isNotNull())
        .groupBy(F.col("name").alias("engineer"))
        .agg(F.min("issue_date").alias("first_issue"))
    )


def portfolio_of_holders(certs: DataFrame, led: DataFrame, rollup: DataFrame) -> DataFrame:
    """credential -> engineer -> works led -> client -> that client's whole portfolio.

    Each hop is reduced before the next: one row per holder, distinct (engineer, client) pairs,
    one rollup row per client. No hop multiplies credentials with works.
    """
    pairs = led.select("engineer", "client_name").distinct()
    return first_issue(certs).join(pairs, "engineer").join(rollup, "client_name")


def totals_of_containing_leads(works: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Σ value of the works whose lead's name contains the given name: (name, engineer_total).

    Works are summed per lead first, so only distinct lead names are searched.
    """
    per_lead = (
        works.filter(present(works, "lead_engineer"))
        .groupBy("lead_engineer")
        .agg(F.sum("value_inr").alias("lead_total"))
    )
    leads = per_lead.select("lead_engineer", F.col("lead_engineer").alias("_searched"))
    hits = contained_names(leads, names, "lead_engineer", "_searched", name)
    return hits.join(per_lead, "lead_engineer").groupBy(name).agg(F.sum("lead_total").alias("engineer_total"))


def tied_candidates(resolved: DataFrame, works: DataFrame) -> DataFrame:
    """Every candidate of an open question with its own figures: (qid, client_name, n_works, awarded)."""
    open_ones = resolved.select("qid", F.explode("tied").alias("client_name"))
    return open_ones.join(client_works(works).select("client_name", "n_works", "awarded"), "client_name")
