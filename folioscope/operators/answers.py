"""Batch answering: every question of a table at once, one join per kind of fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions import fixed_values as fv
from folioscope.functions.dates import parse_date, written_date
from folioscope.operators import portfolio
from folioscope.operators.classify import PHRASE_TAGS, tag, with_shape
from folioscope.operators.linking import category_spans, stored_category
from folioscope.operators.lookup import broadcast_checked, left_lookup
from folioscope.operators.ranking import sum_after, sum_at_or_above
from folioscope.session import cut_lineage

ANSWER = "decimal(28,2)"


def answer_questions(linked: DataFrame, works: DataFrame, receivables: DataFrame, certs: DataFrame) -> DataFrame:
    """Linked questions (qid, question, answer_type, entities...) -> (qid, shape, answer).

    The answer is NULL when the question could not be tied to an entity. Parameterised shapes
    (bars, dates) are evaluated once per distinct (key, parameter), never per question and row.
    A question meets the facts of its own shape only, and leaves its text behind before it does.
    """
    read = with_shape(tag(linked, "question", {"is_difference": PHRASE_TAGS["is_difference"]}))
    dated = F.col("shape").isin("date_span", "temporal_chain")
    # Mentions are read once, as columns, and only where the shape uses them.
    read = read.withColumns(
        {
            "mentioned": F.when(F.col("shape") == "category_diff", category_spans("question")),
            "date_text": F.when(dated, written_date("question")),
        }
    ).withColumns(
        {"mention_1": F.try_element_at("mentioned", F.lit(1)), "mention_2": F.try_element_at("mentioned", F.lit(2))}
    )

    # Lookup keys exist only where the shape uses them.
    def key(name: str | Column, *shapes: str) -> Column:
        return F.when(F.col("shape").isin(*shapes), F.col(name) if isinstance(name, str) else name)

    bar = F.when(F.col("threshold_inr") > 0, F.col("threshold_inr"))
    asked = read.select(
        "qid", "answer_type", "is_difference", "shape", "client_name", "engineer", "issue_date", "completion_date",
        key(bar, "threshold_aggregate", "gap_to_threshold").alias("bar"),
        key(stored_category("excluded_category", fv.EXCLUSION_SYNONYMS), "exclusion_aggregate").alias("category"),
        key(stored_category("mention_1"), "category_diff").alias("category_1"),
        key(stored_category("mention_2"), "category_diff").alias("category_2"),
        key(F.try_element_at("years", F.lit(1)), "annual_diff").alias("year_1"),
        key(F.try_element_at("years", F.lit(2)), "annual_diff").alias("year_2"),
        parse_date("date_text").alias("date_named"),
    )
    issues = broadcast_checked(cut_lineage(portfolio.first_issue(certs)))
    asked = left_lookup(asked, issues, ["engineer"]).withColumn("issued", F.coalesce("issue_date", "first_issue", "date_named"))
    # The parameters of all questions feed the fact tables below as well as the final join.
    asked = cut_lineage(asked.withColumn("start", key("issued", "temporal_chain")).drop("issue_date", "first_issue", "date_named"))

    def of(*shapes: str) -> DataFrame:
        return asked.filter(F.col("shape").isin(*shapes))

    bars = sum_at_or_above(works, of("threshold_aggregate").filter("bar IS NOT NULL"), "client_name", "value_inr", "bar")
    after = sum_after(
        works.withColumn("engineer", F.col("lead_engineer")),
        asked.filter("start IS NOT NULL"), "engineer", "completion_date", "value_inr", "start",
    )
    categories, years = portfolio.category_totals(works), portfolio.year_totals(works)
    clients = cut_lineage(portfolio.client_shapes(works, receivables))

    def lookup(df: DataFrame, source: DataFrame, column: str, value: str) -> DataFrame:
        for n in ("1", "2"):
            side = source.withColumnsRenamed({column: f"{column}_{n}", value: f"{value}_{n}"})
            df = left_lookup(df, side, ["client_name", f"{column}_{n}"])
        return df

    def gap(a: str, b: str) -> Column:
        return F.abs(F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0)))

    known_client, known_engineer = F.col("client_name").isNotNull(), F.col("engineer").isNotNull()
    total = F.col("client_total")

    def of_client(value: Column) -> Column:
        """A known client without such facts has 0; only an unknown one has no answer."""
        return F.when(known_client, F.coalesce(value, F.lit(0)))

    # (questions with the facts they need, value of each of their shapes)
    groups: list[tuple[DataFrame, dict[str, Column]]] = []
    by_client = {
        "absence": of_client(F.col("absence")),
        "referenced_share": of_client(F.col("referenced_share")),
        "avg_work_size": of_client(F.col("avg_work_size")),
        "mean_vs_median": of_client(F.col("mean_vs_median")),
        "rank_value": of_client(F.col("rank_value")),
        "gap_to_threshold": F.when(known_client, F.coalesce("bar", F.lit(0)) - F.coalesce(total, F.lit(0))),
        "billing_shortfall": of_client(F.col("billing_shortfall")),
        "outstanding_balance": of_client(F.col("outstanding_balance")),
        "collection_rate": of_client(F.col("collection_rate")),
    }
    groups.append((left_lookup(of(*by_client), clients, ["client_name"]), by_client))
    # Without a readable bar every work counts.
    above = of_client(F.when(F.col("bar").isNotNull(), F.col("total_at_or_above")).otherwise(total))
    barred = left_lookup(left_lookup(of("threshold_aggregate"), clients, ["client_name"]), bars, ["client_name", "bar"])
    groups.append((barred, {"threshold_aggregate": above}))
    # A category the client has no works in excludes nothing.
    kept = left_lookup(of("exclusion_aggregate"), clients, ["client_name"])
    kept = left_lookup(kept, portfolio.exclusion_totals(works), ["client_name", "category"])
    groups.append((kept, {"exclusion_aggregate": of_client(F.coalesce("exclusion_total", "client_total"))}))
    alone = of("hop_aggregate").filter("client_name IS NULL").select("engineer")
    whole = left_lookup(of("hop_aggregate"), clients, ["client_name"])
    whole = left_lookup(whole, portfolio.totals_of_containing_leads(works, alone, "engineer"), ["engineer"])
    groups.append((whole, {"hop_aggregate": F.when(known_client, of_client(total)).otherwise(F.col("engineer_total"))}))
    diff = F.when(known_client & F.col("category_2").isNotNull(), gap("category_total_1", "category_total_2"))
    groups.append((lookup(of("category_diff"), categories, "category", "category_total"), {"category_diff": diff}))
    change = F.when(known_client & F.col("year_2").isNotNull(), gap("year_total_1", "year_total_2"))
    groups.append((lookup(of("annual_diff"), years, "year", "year_total"), {"annual_diff": change}))
    led = left_lookup(of("distinct_count"), portfolio.engineer_shapes(works).select("engineer", "distinct_count"), ["engineer"])
    groups.append((led, {"distinct_count": F.when(known_engineer, F.coalesce("distinct_count", F.lit(0)))}))
    later = left_lookup(of("temporal_chain"), after, ["engineer", "start"])
    since = F.when(known_engineer & F.col("start").isNotNull(), F.coalesce("total_after", F.lit(0)))
    groups.append((later, {"temporal_chain": since}))
    groups.append((of("date_span"), {"date_span": F.abs(F.datediff("completion_date", "issued"))}))

    parts = []
    for facts, by_shape in groups:
        chosen = F
        for shape, value in by_shape.items():
            chosen = chosen.when(F.col("shape") == shape, value.cast(ANSWER))
        parts.append(facts.select("qid", "answer_type", "shape", "is_difference", chosen.alias("answer")))
    return _rounded(reduce(DataFrame.unionByName, parts))


def shape_results(df: DataFrame) -> DataFrame:
    """Round by unit, and give money questions worded as a difference without their sign."""
    return _rounded(tag(df, "question", {"is_difference": PHRASE_TAGS["is_difference"]}))


def _rounded(df: DataFrame) -> DataFrame:
    value, kind = F.col("answer"), F.col("answer_type")
    rounded = F.when(kind == "percent", F.bround(value, 2)).otherwise(F.bround(value, 0)).cast(ANSWER)
    unsigned = (kind == "money") & F.col("is_difference")
    return (
        df.withColumn("answer", rounded)
        .withColumn("answer", F.when(unsigned, F.abs(value)).otherwise(value))
        .drop("is_difference")
    )


def submission_rows(answers: DataFrame) -> DataFrame:
    """(pos, question_id, answer) with 0 for unanswered questions."""
    return answers.select("pos", F.col("qid").alias("question_id"), F.coalesce("answer", F.lit(0)).cast(ANSWER).alias("answer"))


