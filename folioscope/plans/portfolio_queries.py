"""Registered queries over works, receivables, leads and credentials: (Spark, oracle SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions.dates import days_between
from folioscope.functions.numeric import percent, whole
from folioscope.operators import merge, portfolio, ranking
from folioscope.plans import views as v
from folioscope.plans.views import with_views
from folioscope.sources.tables import register_sql

QUERIES: dict = {}


def query(sql: str | None, *ctes: str):
    def add(fn):
        QUERIES[fn.__name__] = (fn, with_views(sql, *ctes) if sql else None)
        return fn

    return add


def _client(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("client_name", "client")


@query(
    """SELECT coalesce(w.client_name, r.client_name) AS client,
              CAST(coalesce(n_works, 0) AS BIGINT) AS total_projects_count,
              coalesce(awarded, 0) AS total_awarded_inr,
              CAST(coalesce(n_referenced, 0) AS BIGINT) AS referenced_projects_count,
              CAST(coalesce(n_works - n_referenced, 0) AS BIGINT) AS unreferenced_projects_count,
              coalesce(invoiced, 0) AS total_invoiced_inr, coalesce(received, 0) AS total_received_inr,
              coalesce(outstanding, 0) AS total_outstanding_inr
       FROM work_stats w FULL JOIN bill_stats r ON w.client_name = r.client_name""",
    "work_stats", "bill_stats",
)
def client_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return _client(portfolio.client_rollup(v.flagged_works(spark, sf), v.receivables(spark, sf)))


@query(
    """SELECT client_name AS client, count(*) AS n_unreferenced FROM works w
       WHERE NOT EXISTS (SELECT 1 FROM letters l WHERE l.work_id = w.work_id) GROUP BY client_name""",
    "works", "letters",
)
def absence_by_client(spark: SparkSession, sf: str) -> DataFrame:
    missing = merge.without_reference(v.works(spark, sf), v.letters(spark, sf), "work_id")
    return _client(missing.groupBy("client_name").agg(F.count("*").alias("n_unreferenced")))


@query(
    """SELECT client_name AS client, round_even(CAST(100.0 * n_referenced / n_works AS DOUBLE), 2) AS referenced_share FROM work_stats""",
    "work_stats",
)
def referenced_share(spark: SparkSession, sf: str) -> DataFrame:
    stats = portfolio.client_works(v.flagged_works(spark, sf))
    return _client(stats.select("client_name", percent("n_referenced", "n_works").alias("referenced_share")))


@query("SELECT client_name AS client, CAST(sum(value_inr) AS BIGINT) AS total FROM works GROUP BY client_name", "works")
def client_total(spark: SparkSession, sf: str) -> DataFrame:
    return _client(v.works(spark, sf).groupBy("client_name").agg(F.sum("value_inr").alias("total")))


@query(
    "SELECT client_name AS client, CAST(round_even(avg(value_inr), 0) AS BIGINT) AS avg_size FROM works GROUP BY client_name",
    "works",
)
def avg_work_size(spark: SparkSession, sf: str) -> DataFrame:
    return _client(v.works(spark, sf).groupBy("client_name").agg(whole(F.avg("value_inr")).alias("avg_size")))


@query(
    """SELECT client_name AS client, median(value_inr) AS median_value,
              CAST(round_even(avg(value_inr) - median(value_inr), 0) AS BIGINT) AS mean_minus_median
       FROM works GROUP BY client_name""",
    "works",
)
def mean_vs_median(spark: SparkSession, sf: str) -> DataFrame:
    w = v.works(spark, sf)
    medians = ranking.exact_median(w, ["client_name"], "value_inr", "median_value")
    means = w.groupBy("client_name").agg(F.avg("value_inr").alias("mean_value"))
    return _client(medians.join(means, "client_name")).select(
        "client", "median_value", whole(F.col("mean_value") - F.col("median_value")).alias("mean_minus_median")
    )


@query(
    """SELECT category, median(value_inr) AS median_value, count(*) AS n FROM works GROUP BY category""", "works"
)
def median_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Five very large groups: the median must not gather a group in one task."""
    return ranking.exact_median(v.works(spark, sf), ["category"], "value_inr", "median_value").select(
        "category", "median_value", "n"
    )


@query(
    """SELECT client_name AS client, CAST(max(value_inr) FILTER (WHERE rn = 1)
              - coalesce(max(value_inr) FILTER (WHERE rn = 2), 0) AS BIGINT) AS rank_gap
       FROM (SELECT *, row_number() OVER (PARTITION BY client_name ORDER BY value_inr DESC, work_id) AS rn FROM works)
       GROUP BY client_name""",
    "works",
)
def rank_gap(spark: SparkSession, sf: str) -> DataFrame:
    return _client(ranking.top_two_gap(v.works(spark, sf), ["client_name"], "value_inr", "work_id", "rank_gap"))


@query(
    """SELECT client_name AS client, work_id, value_inr,
              row_number() OVER (PARTITION BY client_name ORDER BY value_inr DESC, work_id) AS rank FROM works""",
    "works",
)
def ranked_values(spark: SparkSession, sf: str) -> DataFrame:
    w = v.works(spark, sf).select("client_name", "work_id", "value_inr")
    return _client(ranking.rank_descending(w, ["client_name"], "value_inr", "work_id"))


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    """Two bars per client, derived from its account balance."""
    balance = v.cents(F.abs(F.col("c_acctbal")))
    return v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("client_name"), F.explode(F.array(balance * 20, balance * 45)).alias("bar")
    )


BARS_SQL = """bars AS (SELECT DISTINCT c_custkey AS client_name,
        unnest([CAST(round(abs(c_acctbal) * 100) AS BIGINT) * 20, CAST(round(abs(c_acctbal) * 100) AS BIGINT) * 45]) AS bar
        FROM customer)"""


def threshold_total(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking.sum_at_or_above(v.works(spark, sf), _bars(spark, sf), "client_name", "value_inr", "bar")
    return _client(out)


QUERIES["threshold_total"] = (
    threshold_total,
    with_views("", "works").rstrip() + ", " + BARS_SQL + """
    SELECT b.client_name AS client, b.bar, CAST(coalesce(sum(w.value_inr), 0) AS BIGINT) AS total_at_or_above
    FROM bars b LEFT JOIN works w ON w.client_name = b.client_name AND w.value_inr >= b.bar
    GROUP BY b.client_name, b.bar""",
)


def gap_to_threshold(spark: SparkSession, sf: str) -> DataFrame:
    totals = v.works(spark, sf).groupBy("client_name").agg(F.sum("value_inr").alias("total"))
    gap = _bars(spark, sf).distinct().join(totals, "client_name", "left")
    return _client(gap.select("client_name", "bar", (F.col("bar") - F.coalesce("total", F.lit(0))).alias("gap")))


QUERIES["gap_to_threshold"] = (
    gap_to_threshold,
    with_views("", "works").rstrip() + ", " + BARS_SQL + """
    SELECT b.client_name AS client, b.bar, CAST(b.bar - coalesce(t.total, 0) AS BIGINT) AS gap
    FROM bars b LEFT JOIN (SELECT client_name, sum(value_inr) AS total FROM works GROUP BY client_name) t
    ON t.client_name = b.client_name""",
)


@query(
    """SELECT c.client_name AS client, c.category,
              CAST(coalesce(sum(w.value_inr), 0) AS BIGINT) AS exclusion_total
       FROM (SELECT DISTINCT client_name, category FROM works) c
       LEFT JOIN works w ON w.client_name = c.client_name AND w.category <> c.category
       GROUP BY c.client_name, c.category""",
    "works",
)
def exclusion_total(spark: SparkSession, sf: str) -> DataFrame:
    return _client(portfolio.exclusion_totals(v.works(spark, sf)))


@query(
    """SELECT client_name AS client,
              CAST(abs(sum(CASE WHEN category = '1-URGENT' THEN value_inr ELSE 0 END)
                     - sum(CASE WHEN category = '5-LOW' THEN value_inr ELSE 0 END)) AS BIGINT) AS difference
       FROM works GROUP BY client_name""",
    "works",
)
def category_diff(spark: SparkSession, sf: str) -> DataFrame:
    def total(name: str):
        return F.sum(F.when(F.col("category") == name, F.col("value_inr")).otherwise(0))

    diff = F.abs(total("1-URGENT") - total("5-LOW"))
    return _client(v.works(spark, sf).groupBy("client_name").agg(diff.alias("difference")))


@query(
    """SELECT client_name AS client, CAST(abs(coalesce(sum(value_inr) FILTER (WHERE year(completion_date) = 1996), 0)
              - coalesce(sum(value_inr) FILTER (WHERE year(completion_date) = 1998), 0)) AS BIGINT) AS difference
       FROM works GROUP BY client_name""",
    "works",
)
def annual_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Every client has a difference, 0 where it has no works in either year."""
    day = F.col("completion_date")

    def in_year(y: int):
        return (day >= F.lit(f"{y}-01-01").cast("date")) & (day < F.lit(f"{y + 1}-01-01").cast("date"))

    def total(y: int):
        return F.sum(F.when(in_year(y), F.col("value_inr")).otherwise(0))

    return _client(v.works(spark, sf).groupBy("client_name").agg(F.abs(total(1996) - total(1998)).alias("difference")))


@query(
    """SELECT coalesce(w.client_name, r.client_name) AS client,
              CAST(abs(coalesce(awarded, 0) - coalesce(invoiced, 0)) AS BIGINT) AS shortfall
       FROM work_stats w FULL JOIN bill_stats r ON w.client_name = r.client_name""",
    "work_stats", "bill_stats",
)
def billing_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    awarded = v.works(spark, sf).groupBy("client_name").agg(F.sum("value_inr").alias("awarded"))
    billed = portfolio.client_billing(v.receivables(spark, sf)).select("client_name", "invoiced")
    gap = F.abs(F.coalesce("awarded", F.lit(0)) - F.coalesce("invoiced", F.lit(0)))
    return _client(awarded.join(billed, "client_name", "full_outer").select("client_name", gap.alias("shortfall")))


@query("SELECT client_name AS client, outstanding FROM bill_stats", "bill_stats")
def outstanding(spark: SparkSession, sf: str) -> DataFrame:
    return _client(portfolio.client_billing(v.receivables(spark, sf)).select("client_name", "outstanding"))


@query(
    """SELECT client_name AS client, CASE WHEN invoiced > 0 THEN round_even(CAST(100.0 * received / invoiced AS DOUBLE), 2) ELSE 0 END
              AS collection_rate FROM bill_stats""",
    "bill_stats",
)
def collection_rate(spark: SparkSession, sf: str) -> DataFrame:
    billing = portfolio.client_billing(v.receivables(spark, sf))
    return _client(billing.select("client_name", percent("received", "invoiced").alias("collection_rate")))


@query(
    """SELECT lead_id, count(DISTINCT category) AS n_categories, CAST(sum(value_inr) AS BIGINT) AS total,
              count(*) AS n_led
       FROM works JOIN leads ON works.work_id = leads.work_id GROUP BY lead_id""",
    "works", "leads",
)
def distinct_categories_by_lead(spark: SparkSession, sf: str) -> DataFrame:
    led = v.works(spark, sf).join(v.leads(spark, sf).withColumnRenamed("lead_id", "lead_engineer"), "work_id")
    return portfolio.engineer_shapes(led).select(
        F.col("engineer").alias("lead_id"),
        F.col("distinct_count").alias("n_categories"),
        F.col("engineer_total").alias("total"),
        "n_led",
    )


PERSON = v.person_name_sql("s_suppkey")


@query(
    f"""SELECT l.work_id, s.emp_id AS lead_engineer_id
        FROM leads l JOIN (SELECT s_suppkey, {PERSON} AS name FROM supplier) n ON n.s_suppkey = l.lead_id
        LEFT JOIN (SELECT lower(CASE WHEN s_nationkey < 20 THEN {PERSON} END) AS k, min(CAST(s_suppkey AS VARCHAR)) AS emp_id
                   FROM supplier GROUP BY 1) s ON s.k = CASE WHEN l.work_id % 11 <> 0 THEN lower(n.name) END""",
    "leads",
)
def lead_key_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Some people of the roster and some leads have no name; such works keep a NULL id."""
    name = F.when(F.col("s_nationkey") < 20, v.person_name("s_suppkey"))
    roster = v.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("emp_id"), name.alias("name"))
    lead = F.when(F.col("work_id") % 11 != 0, F.upper(v.person_name("lead_id")))
    named = v.leads(spark, sf).select("work_id", lead.alias("lead_engineer"))
    return merge.backfill_lead_ids(named, roster).select("work_id", "lead_engineer_id")


@query(
    """SELECT w.person, i.first_issue, CAST(coalesce(sum(value_inr) FILTER (WHERE done > first_issue), 0) AS BIGINT) AS total_after
       FROM led_works w JOIN (SELECT person, min(issue_date) AS first_issue FROM certs GROUP BY person) i
         ON i.person = w.person GROUP BY w.person, i.first_issue""",
    "led_works", "certs",
)
def value_after_credential(spark: SparkSession, sf: str) -> DataFrame:
    issued = v.certs(spark, sf).groupBy("person").agg(F.min("issue_date").alias("first_issue"))
    led = v.led_works(spark, sf)
    done = led.select("person").distinct()
    after = ranking.sum_after(led, issued.join(done, "person"), "person", "done", "value_inr", "first_issue")
    return after.select("person", "first_issue", "total_after")


@query(
    """SELECT c.person, CAST(abs(date_diff('day', c.first_issue, w.last_done)) AS INTEGER) AS days
       FROM (SELECT person, min(issue_date) AS first_issue FROM certs GROUP BY person) c
       JOIN (SELECT person, max(done) AS last_done FROM led_works GROUP BY person) w ON w.person = c.person""",
    "certs", "led_works",
)
def days_to_last_work(spark: SparkSession, sf: str) -> DataFrame:
    issued = v.certs(spark, sf).groupBy("person").agg(F.min("issue_date").alias("first_issue"))
    last = v.led_works(spark, sf).groupBy("person").agg(F.max("done").alias("last_done"))
    return issued.join(last, "person").select("person", days_between("first_issue", "last_done").alias("days"))


@query(
    """SELECT p.person, p.client, p.first_issue, t.n_works AS client_works, t.awarded AS client_total
       FROM (SELECT DISTINCT l.lead_id AS person, w.client_name AS client, c.first_issue
             FROM leads l JOIN works w ON w.work_id = l.work_id
             JOIN (SELECT person, min(issue_date) AS first_issue FROM certs GROUP BY person) c
               ON c.person = l.lead_id) p
       JOIN (SELECT client_name, count(*) AS n_works, CAST(sum(value_inr) AS BIGINT) AS awarded
             FROM works GROUP BY client_name) t ON t.client_name = p.client""",
    "works", "leads", "certs",
)
def credential_chain(spark: SparkSession, sf: str) -> DataFrame:
    """credential -> engineer -> works led -> client -> the client's whole portfolio."""
    w = v.works(spark, sf)
    rollup = w.groupBy("client_name").agg(F.count("*").alias("client_works"), F.sum("value_inr").alias("client_total"))
    led = v.leads(spark, sf).join(w.select("work_id", "client_name"), "work_id")
    issued = v.certs(spark, sf).withColumnRenamed("person", "name")
    chain = portfolio.portfolio_of_holders(issued, led.withColumnRenamed("lead_id", "engineer"), rollup)
    return chain.select(
        F.col("engineer").alias("person"), F.col("client_name").alias("client"), "first_issue", "client_works", "client_total"
    )


@query(
    """SELECT client_name AS client, count(*) AS n, percent_ref, max_gap FROM (
         SELECT client_name, round_even(100.0 * count(*) FILTER (WHERE has_reference_letter)
                  OVER (PARTITION BY client_name) / count(*) OVER (PARTITION BY client_name), 2) AS percent_ref,
                max(abs(date_diff('day', DATE '1998-01-01', completion_date))) OVER (PARTITION BY client_name) AS max_gap
         FROM flagged_works) GROUP BY client_name, percent_ref, max_gap""",
    "flagged_works",
)
def sql_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Plain SQL over the registered views with the SQL-defined functions."""
    register_sql(spark, {"portfolio_works": v.flagged_works(spark, sf)})
    return spark.sql(
        """SELECT client_name AS client, count(*) AS n,
                  PERCENT(count_if(has_reference_letter), count(*)) AS percent_ref,
                  CAST(max(DAYS_BETWEEN('1998-01-01', CAST(completion_date AS STRING))) AS BIGINT) AS max_gap
           FROM portfolio_works GROUP BY client_name"""
    )


@query(
    """SELECT 'works' AS table_name, count(*) AS n_rows FROM orders
       UNION ALL SELECT 'receivables', count(*) FROM lineitem
       UNION ALL SELECT 'assets', count(*) FROM part
       UNION ALL SELECT 'clients', count(*) FROM customer
       UNION ALL SELECT 'certs', count(*) FROM certs""",
    "certs",
)
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = {"works": "orders", "receivables": "lineitem", "assets": "part", "clients": "customer"}
    tables = {k: v.table(spark, sf, t) for k, t in names.items()}
    return merge.row_counts(tables | {"certs": v.certs(spark, sf)})


@query(
    """SELECT p_brand, min(p_name) AS p_name FROM part WHERE p_name IS NOT NULL AND p_name <> ''
       GROUP BY p_brand, lower(p_name)"""
)
def catalogs(spark: SparkSession, sf: str) -> DataFrame:
    parts = v.table(spark, sf, "part")
    labelled = parts.select(F.concat_ws("|", "p_brand", "p_name").alias("name"))
    split = F.split("name", r"\|")
    return merge.catalog(labelled, "name").select(split[0].alias("p_brand"), split[1].alias("p_name"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    keyed = lines.withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    return merge.duplicate_keys(keyed, "key").select("key.l_orderkey", "key.l_linenumber", "n_rows")


@query(
    """SELECT user_id, event_id, event_type, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    events = v.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return merge.latest_per_key(events, "user_id", "event_id")


@query(
    """SELECT DISTINCT client_name AS client FROM (
         SELECT client_name FROM works UNION SELECT client_name FROM receivables)""",
    "works", "receivables",
)
def all_clients(spark: SparkSession, sf: str) -> DataFrame:
    """UNION of the client names of both facts; each side is reduced before they meet."""
    w = v.works(spark, sf).select("client_name").distinct()
    return _client(w.union(v.receivables(spark, sf).select("client_name").distinct()).distinct())


@query(
    f"""SELECT n.name, CAST(sum(w.value_inr) AS BIGINT) AS total
        FROM (SELECT DISTINCT substr({v.person_name_sql('s_suppkey')}, 1, length({v.person_name_sql('s_suppkey')}) - 1) AS name
              FROM supplier) n
        JOIN (SELECT {v.person_name_sql('lead_id')} AS lead, sum(value_inr) AS value_inr
              FROM leads JOIN works ON works.work_id = leads.work_id GROUP BY lead_id) w
          ON contains(lower(w.lead), lower(n.name)) GROUP BY n.name""",
    "works", "leads",
)
def lead_contains_total(spark: SparkSession, sf: str) -> DataFrame:
    """Works whose lead's name contains a given (cut-off) name."""
    full = v.person_name("s_suppkey")
    names = v.table(spark, sf, "supplier").select(full.substr(F.lit(1), F.length(full) - 1).alias("name"))
    led = v.works(spark, sf).join(v.leads(spark, sf), "work_id").select(
        v.person_name("lead_id").alias("lead_engineer"), "value_inr"
    )
    totals = portfolio.totals_of_containing_leads(led, names, "name")
    return totals.withColumnRenamed("engineer_total", "total")


@query(
    """SELECT q.qid, q.client, s.n_works, s.awarded
       FROM (SELECT o_orderkey AS qid, unnest([o_custkey, o_custkey + 1]) AS client FROM orders) q
       JOIN work_stats s ON s.client_name = q.client""",
    "work_stats",
)
def tied_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Open questions keep all their candidates, each with its own figures."""
    open_questions = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("qid"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("tied")
    )
    return _client(portfolio.tied_candidates(open_questions, v.flagged_works(spark, sf)))
