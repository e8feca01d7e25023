"""Texts rendered from the given tables: questions, documents and sheets, one per key.

Rendering turns numeric columns into the wording and layouts the engine reads, so every parser
can be checked against the number it started from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions.money import indian_grouping
from folioscope.plans import views as v

# Question templates: (id, answer type, expected shape, text). {c} is the client's name.
CLIENT_QUESTIONS = [
    (1, "count", "absence", "For {c}, how many completed works lack a client reference letter on file?"),
    (2, "percent", "referenced_share", "What share of the works for {c} carries a reference letter?"),
    (3, "percent", "collection_rate", "{c}: what percent of what we invoiced has been collected so far?"),
    (4, "money", "hop_aggregate", "What is the combined value of every completed work for {c}?"),
    (5, "money", "avg_work_size", "What is the average size across all completed projects for {c}?"),
    (6, "money", "mean_vs_median", "For {c}, what is the gap between the mean and the median of our works?"),
    (7, "money", "rank_value", "{c}, by how much does the largest completed work exceed the second largest?"),
    (8, "money", "threshold_aggregate", "{c}, what is the value of their works crossing the two crore mark?"),
    (9, "money", "gap_to_threshold", "{c} is under review, so how much additional work must we win to reach INR 20 Cr?"),
    (10, "money", "exclusion_aggregate", "{c}; excluding tunnels, what is the value of what we delivered?"),
    (11, "money", "billing_shortfall", "For {c}, what is the shortfall of the invoiced amount against our awards?"),
    (12, "money", "outstanding_balance", "How much does {c} still owe us on the bills we sent?"),
    (13, "money", "category_diff", "For {c}, how do irrigation and water supply compare in rupees?"),
    (14, "money", "annual_diff", "For {c}, compare the work of 2012 with 2011, then 2016."),
]
# {e} is an engineer's name, {p} the package of one of their works.
ENGINEER_QUESTIONS = [
    (21, "count", "distinct_count", "How many different kinds of work has {e} led?"),
    (22, "money", "temporal_chain", "What did {e} deliver in works completed after the PMP certification date?"),
    (23, "days", "date_span", "How long from {e}'s PMP to the finish of {p}?"),
]


def client_questions(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, question, answer_type, client, template) for every customer and template."""
    templates = F.array(
        *[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k"), F.lit(q).alias("q")) for t, k, _, q in CLIENT_QUESTIONS]
    )
    return (
        v.spread(v.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
        .select("c_custkey", "c_name", F.explode(templates).alias("x"))
        .select(
            F.concat_ws("-", F.lit("c"), "c_custkey", "x.t").alias("qid"),
            F.replace("x.q", F.lit("{c}"), "c_name").alias("question"),
            F.col("x.k").alias("answer_type"),
            F.col("c_custkey").alias("entity"),
            F.col("x.t").alias("template"),
        )
    )


def client_questions_sql() -> str:
    rows = ", ".join(f"({t}, '{k}', '{q}')" for t, k, _, q in CLIENT_QUESTIONS)
    return f"""client_questions AS (
        SELECT concat('c-', c_custkey, '-', t) AS qid, replace(q, '{{c}}', c_name) AS question,
               k AS answer_type, c_custkey AS entity, t AS template
        FROM customer CROSS JOIN (VALUES {rows}) AS x(t, k, q))"""


def named_works(spark: SparkSession, sf: str) -> DataFrame:
    """Works with the names people use: client, lead engineer, package and title."""
    flagged = v.flagged_works(spark, sf).drop("doc_id", "category")
    base = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id"), v.category_name().alias("category"))
    names = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("client_name"), "c_name")
    return (
        flagged.join(base, "work_id")
        .join(v.leads(spark, sf), "work_id", "left")
        .join(names, "client_name")
        .select(
            F.lpad(F.col("work_id").cast("string"), 12, "0").alias("doc_id"),
            title("work_id").alias("project_name"),
            F.col("c_name").alias("client_name"),
            "category",
            "value_inr",
            F.add_months("completion_date", 12 * v.WORK_SHIFT_YEARS).alias("completion_date"),
            F.when(F.col("lead_id").isNotNull(), v.person_name("lead_id")).alias("lead_engineer"),
            F.concat(F.lit("Pkg-"), F.col("work_id").cast("string")).alias("package_no"),
            "has_reference_letter",
        )
    )


WORK_KINDS = ["Ring Road", "School Building", "Check Dam", "Rail Tunnel", "Cable Stayed Bridge"]
WORK_STATES = ["Gujarat", "Jharkhand", "Madhya Pradesh", "West Bengal"]


def title(key: str) -> Column:
    """'Ring Road — Gujarat Pkg-12'."""
    k = F.col(key)
    kinds, states = F.array(*map(F.lit, WORK_KINDS)), F.array(*map(F.lit, WORK_STATES))
    return F.concat(
        F.element_at(kinds, (k % len(WORK_KINDS) + 1).cast("int")), F.lit(" — "),
        F.element_at(states, (k % len(WORK_STATES) + 1).cast("int")), F.lit(" Pkg-"), k.cast("string"),
    )


def title_sql(key: str) -> str:
    kinds = "[" + ", ".join(f"'{x}'" for x in WORK_KINDS) + "]"
    states = "[" + ", ".join(f"'{x}'" for x in WORK_STATES) + "]"
    return (
        f"concat({kinds}[CAST({key} % {len(WORK_KINDS)} + 1 AS INTEGER)], ' — ', "
        f"{states}[CAST({key} % {len(WORK_STATES)} + 1 AS INTEGER)], ' Pkg-', {key})"
    )


def named_receivables(spark: SparkSession, sf: str) -> DataFrame:
    names = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("client_name"), "c_name")
    sums = v.receivables(spark, sf).groupBy("client_name").agg(
        *[F.sum(c).alias(c) for c in ("invoiced_inr", "received_inr", "outstanding_inr")]
    )
    return sums.join(names, "client_name").drop("client_name").withColumnRenamed("c_name", "client_name")


def engineers(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("emp_id"), v.person_name("s_suppkey").alias("name")
    )


def named_certs(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-up events of people who are engineers, as PMP credentials, dated back."""
    people = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person"))
    return v.certs(spark, sf).join(people, "person").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("doc_id"),
        v.person_name("person").alias("name"),
        F.lit("PMP").alias("cred_type"),
        F.concat(F.lit("PMI-"), F.col("event_id").cast("string")).alias("cred_id"),
        F.date_sub("issue_date", v.CREDENTIAL_SHIFT_DAYS).alias("issue_date"),
    )


def engineer_questions(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, question, answer_type, entity, template); the package is the engineer's first work."""
    first_work = v.leads(spark, sf).groupBy(F.col("lead_id").alias("s_suppkey")).agg(F.min("work_id").alias("work_id"))
    templates = F.array(
        *[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k"), F.lit(q).alias("q")) for t, k, _, q in ENGINEER_QUESTIONS]
    )
    return (
        v.table(spark, sf, "supplier")
        .join(first_work, "s_suppkey")
        .select("s_suppkey", "work_id", v.person_name("s_suppkey").alias("name"), F.explode(templates).alias("x"))
        .select(
            F.concat_ws("-", F.lit("e"), "s_suppkey", "x.t").alias("qid"),
            F.replace(
                F.replace("x.q", F.lit("{e}"), "name"), F.lit("{p}"), F.concat(F.lit("Package "), F.col("work_id").cast("string"))
            ).alias("question"),
            F.col("x.k").alias("answer_type"),
            F.col("s_suppkey").alias("entity"),
            F.col("x.t").alias("template"),
        )
    )


# --- money -----------------------------------------------------------------------------------------


def money_text(value: Column, key: Column) -> Column:
    """The same whole-rupee amount in one of the usual renderings, chosen by the key."""
    dec = value.cast("decimal(20,0)")
    crore = (dec / 10_000_000).cast("decimal(24,7)").cast("string")
    lakh = (dec / 100_000).cast("decimal(24,5)").cast("string")
    return (
        F.when(key % 6 == 0, F.concat(F.lit("INR "), crore, F.lit(" Cr")))
        .when(key % 6 == 1, F.concat(lakh, F.lit(" Lakh")))
        .when(key % 6 == 2, F.concat(F.lit("INR "), indian_grouping(value), F.lit("/-")))
        .when(key % 6 == 3, F.concat(F.lit("Rs. "), indian_grouping(value)))
        .when(key % 6 == 4, F.concat(F.lit("Rs. "), crore, F.lit(" Crore")))
        .otherwise(value.cast("string"))
    )


def date_text(day: Column, key: Column) -> Column:
    """A date in one of the accepted layouts, chosen by the key."""
    layouts = [
        "yyyy-MM-dd", "dd/MM/yyyy", "d-M-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy",
        "dd MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "yyyy/M/d",
    ]
    out = F
    for i, layout in enumerate(layouts):
        out = out.when(key % len(layouts) == i, F.date_format(day, layout))
    return out


# --- documents ---------------------------------------------------------------------------------------

LABELS = [
    ("Name of Work", "Nature / Category", "Contract Value (Original)", "Completion Date", "Contractor's Project Manager"),
    ("Project Name", "Work Category", "Contract Value", "Completion", "Project Manager"),
    ("Work", "Category", "Executed Value", "Completion Date", "Project Lead"),
]


def certificate_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A completion certificate per order, two pages: three labelled layouts and one in prose."""
    w = v.spread(v.table(spark, sf, "orders"), "o_orderkey").select(
        "o_orderkey", "o_custkey", v.cents(F.col("o_totalprice")).alias("value"), v.category_name().alias("category"),
        F.col("o_orderdate").cast("date").alias("day"),
    )
    k = F.col("o_orderkey")
    letterhead = F.concat(F.lit("\n  CLIENT "), F.col("o_custkey").cast("string"), F.lit(" (Govt)\n"))
    lead = v.person_name("o_custkey")
    amount = money_text(F.col("value"), k)
    layout = F
    for i, (work, cat, val, comp, pm) in enumerate(LABELS):
        page = F.concat(
            letterhead, F.lit(f"Completion Certificate\n{work}\n"), title("o_orderkey"),
            F.lit(f"\n{cat}\n"), F.col("category"), F.lit(f"\n{val}\n"), amount,
            F.lit(f"\n{comp}\n"), date_text(F.col("day"), k), F.lit(f"\n{pm}\n"), lead,
        )
        layout = layout.when(k % 4 == i, page)
    prose = F.concat(
        letterhead, F.lit("Completion Certificate: the work of '"), title("o_orderkey"), F.lit("' ("), F.col("category"),
        F.lit("), completed in all respects on "), F.date_format("day", "MMMM d, yyyy"), F.lit(" at a gross executed value of INR "),
        indian_grouping(F.col("value")), F.lit("/- and supervised on the contractor's side by "), lead, F.lit("."),
    )
    pages = F.array(
        F.struct(F.lit(2).alias("page_no"), F.concat(F.lit("Annexure to package "), k.cast("string")).alias("text")),
        F.struct(F.lit(1).alias("page_no"), layout.otherwise(prose).alias("text")),
    )
    return w.select(F.concat(F.lit("DOC-"), k.cast("string")).alias("doc_id"), F.explode(pages).alias("p")).select(
        "doc_id", "p.page_no", "p.text"
    )


def receivables_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """An ageing sheet of all order lines, a third of them without a client."""
    lines = v.spread(v.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")
    return lines.select(
        F.concat_ws("-", F.lit("INV"), "l_orderkey", "l_linenumber").alias("Invoice No"),
        F.when(F.col("l_returnflag") == "A", F.lit("nan"))
        .otherwise(F.concat(F.lit("Client "), F.col("l_suppkey").cast("string"), F.lit(" (Govt)"))).alias("Client"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("Invoice Date"),
        F.concat(F.lit("INR "), indian_grouping(v.cents(F.col("l_extendedprice")))).alias("Invoiced (INR)"),
        F.concat(F.lit(" "), "l_linestatus").alias("Status"),
        F.col("l_quantity").alias("Received (INR)"),
        (-F.col("l_quantity")).cast("string").alias("Outstanding (INR)"),
    )


def asset_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """A plant register of all parts, a fifth of them without an id."""
    key = F.col("p_partkey")
    return v.spread(v.table(spark, sf, "part"), "p_partkey").select(
        F.when(key % 5 == 4, F.lit("n/a")).otherwise(key.cast("string")).alias("Asset ID"),
        F.col("p_type").alias("Type"),
        F.concat(F.lit(" "), "p_brand").alias("Make"),
        F.when(key % 3 == 0, F.lit("unknown")).otherwise((F.col("p_size") + 2000).cast("string")).alias("Acquired"),
        F.col("p_retailprice").alias("Cost (INR)"),
        F.lit("Good").alias("Condition"),
        F.col("p_name").alias("Location"),
        F.lit("Owned").alias("Ownership"),
        (key % 2 == 0).alias("Safety Certified"),
    )
