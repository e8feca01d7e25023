"""Batch answers: a question meets the facts of its own shape, without its text."""

import datetime

from folioscope.functions import money
from folioscope.operators import answers


def test_a_question_meets_the_facts_of_its_shape_only(spark, monkeypatch):
    day = datetime.date(2012, 1, 1)
    works = spark.createDataFrame(
        [("D1", "A", "tunnels", 30_000_000, day, "E", True), ("D2", "A", "irrigation", 5, day, "E", False)],
        "doc_id string, client_name string, category string, value_inr bigint, completion_date date, lead_engineer string, has_reference_letter boolean",
    )
    certs = spark.createDataFrame([("C1", "E", datetime.date(2011, 1, 1))], "doc_id string, name string, issue_date date")
    ledger = spark.createDataFrame([("A", 10, 4, 6)], "client_name string, invoiced_inr bigint, received_inr bigint, outstanding_inr bigint")
    rows = [
        (1, "how many works lack a client reference letter?", "count", "A", None, 0, None, []),
        (2, "the value of works crossing the two crore mark", "money", "A", None, 20_000_000, None, []),
        (3, "excluding tunnels, what is the value?", "money", "A", None, 0, "tunnels", []),
        (4, "How do irrigation and tunnels compare in rupees?", "money", "A", None, 0, None, []),
        (5, "compare the work of 2012 with 2011", "money", "A", None, 0, None, [2011, 2012]),
        (6, "What is the combined value of every work?", "money", "A", None, 0, None, []),
        (6, "What is the combined value of every work?", "money", "A", None, 0, None, []),
        (7, "How many different kinds of work?", "count", None, "E", 0, None, []),
        (8, "works completed after the PMP certification date?", "money", None, "E", 0, None, []),
        (9, "nobody's combined value", "money", None, None, 0, None, []),
    ]
    linked = spark.createDataFrame(
        [(*r, None, None) for r in rows],
        "qid int, question string, answer_type string, client_name string, engineer string, threshold_inr bigint, "
        "excluded_category string, years array<int>, issue_date date, completion_date date",
    )
    met, lookup = [], answers.left_lookup

    def counted(df, side, keys, *args):
        met.append((tuple(keys), df.count(), "question" in df.columns))
        return lookup(df, side, keys, *args)

    monkeypatch.setattr(answers, "left_lookup", counted)
    got = sorted((r["qid"], r["shape"], None if r["answer"] is None else int(r["answer"])) for r in answers.answer_questions(linked, works, ledger, certs).collect())
    assert got == [
        (1, "absence", 1), (2, "threshold_aggregate", 30_000_000), (3, "exclusion_aggregate", 5), (4, "category_diff", 29_999_995),
        (5, "annual_diff", 30_000_005), (6, "hop_aggregate", 30_000_005), (6, "hop_aggregate", 30_000_005), (7, "distinct_count", 2),
        (8, "temporal_chain", 30_000_005), (9, "hop_aggregate", None),
    ]
    # One lookup of all questions (the engineer's first credential), then those of their shape.
    facts = [m for m in met if m[1] < len(rows)]
    assert len(met) - len(facts) == 1 and sum(n for _, n, _ in facts) <= 2 * len(rows) and not any(text for *_, text in facts)


def test_a_bar_is_read_whatever_the_case_of_its_unit(spark):
    texts = ["INR 20 CR", "two CRORE", "3 Lakhs", "1.5cr and 2 lakh", "crossing 20", "LAKH 7 lakhs", None, "acre 5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in sorted(df.select("i", money.threshold_rupees("t")).collect())]
    assert got == [200_000_000, 20_000_000, 300_000, 15_000_000, 0, 700_000, 0, 0]
