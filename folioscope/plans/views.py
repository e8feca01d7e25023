"""The engine's tables as views over the provided parquet tables, in Spark and as SQL.

Each view exists twice: a function building the DataFrame and a CTE of the same name for the
oracle. ``with_views`` prefixes a query with the CTEs it names, in dependency order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Adapter values (ours): categories standing for the five order priorities.
CATEGORY_OF_PRIORITY = {
    "1-URGENT": "roads highways",
    "2-HIGH": "bridges flyovers",
    "3-MEDIUM": "water supply",
    "4-NOT SPECIFIED": "tunnels",
    "5-LOW": "irrigation",
}
# First names for rendered people; the family name spells the key, so full names are unique.
FIRST_NAMES = ["Asha", "Ravi", "Meera", "Imran", "Kavita", "Gautam", "Uma", "Rohit", "Pooja", "Tanvir"]
# Rendered works are moved on into the years questions name, credentials back among them.
WORK_SHIFT_YEARS = 16
CREDENTIAL_SHIFT_DAYS = 3700

SQL = {
    "works": """
        SELECT o_orderkey AS work_id, o_custkey AS client_name, o_orderpriority AS category,
               CAST(round(o_totalprice * 100) AS BIGINT) AS value_inr,
               CAST(o_orderdate AS DATE) AS completion_date
        FROM orders""",
    "letters": "SELECT DISTINCT l_orderkey AS work_id FROM lineitem WHERE l_returnflag = 'R'",
    "flagged_works": """
        SELECT w.*, l.work_id IS NOT NULL AS has_reference_letter
        FROM works w LEFT JOIN letters l ON w.work_id = l.work_id""",
    "receivables": """
        SELECT o.o_custkey AS client_name,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS invoiced_inr,
               CASE WHEN l_linestatus = 'F' THEN CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)
                    ELSE 0 END AS received_inr
        FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey""",
    "work_stats": """
        SELECT client_name, count(*) AS n_works, CAST(sum(value_inr) AS BIGINT) AS awarded,
               count(*) FILTER (WHERE has_reference_letter) AS n_referenced,
               avg(value_inr) AS mean_value, median(value_inr) AS median_value
        FROM flagged_works GROUP BY client_name""",
    "bill_stats": """
        SELECT client_name, CAST(sum(invoiced_inr) AS BIGINT) AS invoiced,
               CAST(sum(received_inr) AS BIGINT) AS received,
               CAST(sum(invoiced_inr - received_inr) AS BIGINT) AS outstanding
        FROM receivables GROUP BY client_name""",
    "leads": """
        SELECT work_id, lead_id FROM (
            SELECT l_orderkey AS work_id, l_suppkey AS lead_id,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS rn
            FROM lineitem) WHERE rn = 1""",
    "certs": "SELECT user_id AS person, event_id, CAST(ts AS DATE) AS issue_date FROM events WHERE event_type = 'signup'",
    "led_works": """
        SELECT user_id AS person, CAST(ts AS DATE) AS done, CAST(round(value * 100) AS BIGINT) AS value_inr
        FROM events WHERE event_type = 'purchase'""",
}
DEPENDS = {
    "flagged_works": ["works", "letters"],
    "work_stats": ["flagged_works"],
    "bill_stats": ["receivables"],
}


def with_views(body: str, *names: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for d in DEPENDS.get(name, []):
            add(d)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over all shuffle partitions.

    A file of narrow rows is one task up to 128 MB, compressed. Where each row becomes many texts that are read by dozens
    of patterns, that task would have the whole work; the bare rows are cheap to move first.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def works(spark: SparkSession, sf: str) -> DataFrame:
    """Works keyed by client id; names are only joined where a query needs them."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("work_id"),
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_custkey").alias("client_name"),
        F.col("o_orderpriority").alias("category"),
        cents(F.col("o_totalprice")).alias("value_inr"),
        F.col("o_orderdate").cast("date").alias("completion_date"),
    )


def letters(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return lines.select(F.col("l_orderkey").alias("work_id")).distinct()


def flagged_works(spark: SparkSession, sf: str) -> DataFrame:
    marked = letters(spark, sf).withColumn("_hit", F.lit(True))
    return (
        works(spark, sf)
        .join(marked, "work_id", "left")
        .withColumn("has_reference_letter", F.col("_hit").isNotNull())
        .drop("_hit")
    )


def receivables(spark: SparkSession, sf: str) -> DataFrame:
    """One invoice per order: lines are summed before they meet the order's client."""
    invoiced = cents(F.col("l_extendedprice"))
    received = F.when(
        F.col("l_linestatus") == "F", cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    ).otherwise(F.lit(0).cast("bigint"))
    invoices = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("invoice_no"))
        .agg(
            F.sum(invoiced).alias("invoiced_inr"),
            F.sum(received).alias("received_inr"),
            F.sum(invoiced - received).alias("outstanding_inr"),
        )
    )
    owner = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("invoice_no"), F.col("o_custkey").alias("client_name")
    )
    return invoices.join(owner, "invoice_no")


def leads(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier of the lowest line number (then lowest supplier) of each order."""
    first = F.min(F.struct("l_linenumber", "l_suppkey"))
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("work_id"))
        .agg(first.alias("f"))
        .select("work_id", F.col("f.l_suppkey").alias("lead_id"))
    )


def certs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'signup'").select(
        F.col("user_id").alias("person"), "event_id", F.col("ts").cast("date").alias("issue_date")
    )


def led_works(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").alias("person"), F.col("ts").cast("date").alias("done"), cents(F.col("value")).alias("value_inr")
    )


# --- rendered names: the same text from the same keys in both engines ------------------------------


def person_name(key: str) -> Column:
    """'Asha bbbbcd' for a numeric key; the expression is written once per engine."""
    firsts = F.array(*[F.lit(n) for n in FIRST_NAMES])
    k = F.col(key)
    family = F.translate(F.lpad(k.cast("string"), 8, "0"), "0123456789", "bcdfghjklm")
    return F.concat(F.element_at(firsts, (k % len(FIRST_NAMES) + 1).cast("int")), F.lit(" "), family)


def person_name_sql(key: str) -> str:
    firsts = "[" + ", ".join(f"'{n}'" for n in FIRST_NAMES) + "]"
    family = f"translate(lpad(CAST({key} AS VARCHAR), 8, '0'), '0123456789', 'bcdfghjklm')"
    return f"concat({firsts}[CAST({key} % {len(FIRST_NAMES)} + 1 AS INTEGER)], ' ', {family})"


def category_name(priority: str = "o_orderpriority") -> Column:
    table_ = F.create_map(*[F.lit(x) for kv in CATEGORY_OF_PRIORITY.items() for x in kv])
    return F.element_at(table_, F.col(priority))


def category_name_sql(priority: str = "o_orderpriority") -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_OF_PRIORITY.items())
    return f"CASE {priority} {cases} END"
