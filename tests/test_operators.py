"""Operators against brute force on small fixtures, and the worked examples."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import Window, functions as F

from folioscope.functions import text as tx
from folioscope.operators import classify, extract, linking, merge, portfolio, ranking, resolve as rs
from folioscope.operators.answers import answer_questions
from folioscope.operators.containment import contained_names


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- ranking --------------------------------------------------------------------------------------


def _skewed(seed=1):
    """One key holds a third of the rows, another only equal values."""
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(-(10**9), 10**9)) for _ in range(700)]
    rows += [("same", 5)] * 400 + [("one", 7)] + [("two", 1), ("two", 4)]
    rows += [(f"k{rng.randrange(60)}", rng.randrange(5000)) for _ in range(900)]
    return [(k, v, i) for i, (k, v) in enumerate(rows)]


def test_exact_median(spark):
    rows = _skewed()
    df = spark.createDataFrame(rows, "k string, v bigint, i bigint").repartition(7)
    expected = {}
    for k, v, _ in rows:
        expected.setdefault(k, []).append(v)
    got = {r["k"]: (r["median"], r["n"]) for r in ranking.exact_median(df, ["k"], "v").collect()}
    assert got == {k: (float(statistics.median(vs)), len(vs)) for k, vs in expected.items()}


def test_rank_and_top_two(spark):
    rows = _skewed(2)
    df = spark.createDataFrame(rows, "k string, v bigint, i bigint").repartition(5)
    groups = {}
    for k, v, i in rows:
        groups.setdefault(k, []).append((-v, i))
    ranks = {(k, i): n + 1 for k, g in groups.items() for n, (_, i) in enumerate(sorted(g))}
    ranked = ranking.rank_descending(df, ["k"], "v", "i")
    assert {(r["k"], r["i"]): r["rank"] for r in ranked.collect()} == ranks
    gaps = {k: (lambda s: s[0] - (s[1] if len(s) > 1 else 0))(sorted((-v for v, _ in g), reverse=True)) for k, g in groups.items()}
    assert {r["k"]: r["gap"] for r in ranking.top_two_gap(df, ["k"], "v", "i").collect()} == gaps


def test_sum_at_or_above(spark):
    rows = [(k, abs(v) % 5000, i) for k, v, i in _skewed(3)]
    df = spark.createDataFrame(rows, "k string, v bigint, i bigint")
    bars = [(k, b) for k in ("hot", "same", "one", "k3", "unknown") for b in (0, 5, 6, 2500, 10**6)]
    got = ranking.sum_at_or_above(df, spark.createDataFrame(bars, "k string, bar bigint"), "k", "v", "bar")
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {
        (k, b): sum(v for kk, v, _ in rows if kk == k and v >= b) for k, b in bars
    }


@pytest.mark.parametrize("values", ["below a million", "equal", "spread"])
def test_hot_keys_are_cut_into_ranges_whatever_their_values(spark, values):
    n = 24_000
    value = {"below a million": F.pmod(F.xxhash64("i"), F.lit(1000)), "equal": F.lit(7), "spread": F.xxhash64("i") % 10**9}[values]
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "other").otherwise("hot").alias("k"), F.col("id").alias("i"))
    df = df.withColumn("v", value.cast("bigint")).repartition(6)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = ranking._ranges(df, ["k"], [F.desc("v"), F.asc("i")]).groupBy(ranking._range_of().alias("r")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(ranges) >= parts - 1 and max(r["count"] for r in ranges) <= 3 * n / parts
    order = Window.partitionBy("k").orderBy(F.desc("v"), "i")
    want = df.withColumn("rank", F.row_number().over(order))
    got = ranking.rank_descending(df, ["k"], "v", "i").select("k", "i", "v", F.col("rank").cast("int"))
    assert got.exceptAll(want).isEmpty() and got.count() == n


def test_ranks_of_empty_tables_and_sums_of_missing_keys(spark):
    none = spark.createDataFrame([], "k string, v bigint, i bigint")
    assert ranking.rank_descending(none, ["k"], "v", "i").collect() == []
    assert ranking.exact_median(none, ["k"], "v").collect() == []
    facts = spark.createDataFrame([("a", 5, 1), ("a", None, 2), (None, 8, 3)], "k string, v bigint, i bigint")
    bars = spark.createDataFrame([("a", 5), ("a", None), (None, 1)], "k string, bar bigint")
    assert [tuple(r) for r in ranking.sum_at_or_above(facts, bars, "k", "v", "bar").collect()] == [("a", 5, 5)]


def test_sum_after_is_strict(spark):
    d = datetime.date
    facts = spark.createDataFrame(
        [("a", d(2020, 1, 1), 1), ("a", d(2020, 1, 2), 10), ("a", d(2020, 1, 2), 5), ("b", d(2020, 1, 5), 7), ("a", None, 99)],
        "k string, day date, v bigint",
    )
    starts = spark.createDataFrame(
        [("a", d(2020, 1, 1)), ("a", d(2020, 1, 2)), ("a", d(2019, 1, 1)), ("b", d(2020, 1, 1)), ("a", d(2020, 1, 1))],
        "k string, start date",
    )
    got = {(r[0], r[1]): r[2] for r in ranking.sum_after(facts, starts, "k", "day", "v", "start").collect()}
    assert got == {
        ("a", d(2020, 1, 1)): 15, ("a", d(2020, 1, 2)): 0, ("a", d(2019, 1, 1)): 16, ("b", d(2020, 1, 1)): 7,
    }


# --- merging ----------------------------------------------------------------------------------------


def _fold(records):
    ordered = sorted(records, key=lambda r: (-r["completeness"], r["seq"]))
    value, client = ordered[0]["value_inr"], ordered[0]["client_name"]
    for r in ordered[1:]:
        if r["value_inr"] > 0 and abs(r["value_inr"] - value) < 1000 and r["value_inr"] != value:
            value = r["value_inr"]
        client = client or r["client_name"]
    return value, client


@pytest.mark.parametrize("chunk", [3, 16, 4096])
def test_merge_records_matches_the_sequential_fold(spark, chunk):
    rng = random.Random(chunk)
    rows, seq = [], 0
    for package, n, spread in [("hot", 400, 6000), ("flip", 300, 2), ("few", 5, 1500), ("lone", 1, 10), ("far", 40, 90000)]:
        for _ in range(n):
            rows.append((package, rng.randrange(4), seq, 10**6 + rng.randrange(spread), rng.choice([None, "", f"C{seq}"])))
            seq += 1
    rng.shuffle(rows)
    cols = ["package_no", "completeness", "seq", "value_inr", "client_name"]
    df = spark.createDataFrame(rows, "package_no string, completeness int, seq bigint, value_inr bigint, client_name string")
    expected = {}
    for r in rows:
        expected.setdefault(r[0], []).append(dict(zip(cols, r)))
    got = {r["package_no"]: (r["value_inr"], r["client_name"]) for r in merge.merge_records(df, chunk_rows=chunk).collect()}
    assert got == {k: (v, c or None) for k, (v, c) in ((k, _fold(g)) for k, g in expected.items())}


def test_merge_near_and_far_values(spark):
    df = spark.createDataFrame(
        [("Pkg-1", 4, 0, 193300000, ""), ("Pkg-1", 3, 1, 193299999, "A"), ("Pkg-1", 2, 2, 193301000, "B"), ("Pkg-2", 1, 3, 50, None)],
        "package_no string, completeness int, seq bigint, value_inr bigint, client_name string",
    )
    assert pairs(merge.merge_records(df), "package_no", "value_inr", "client_name") == [
        ("Pkg-1", 193299999, "A"), ("Pkg-2", 50, None),
    ]


def test_merge_of_far_values_and_runs_over_cell_edges(spark):
    edge = merge.CELL_BUCKETS * merge.SAME_VALUE_RUPEES
    rows = [("far", 1, i, 5000 * i + 7) for i in range(20_000)]
    rows += [("edge", 3, 30_000 + i, edge - 1200 + 600 * i) for i in range(6)] + [("edge", 9, 29_999, edge - 1200)]
    rows += [("none", 2, 40_000, None), ("none", 1, 40_001, 5), ("zero", 2, 40_002, 0), ("zero", 1, 40_003, 5)]
    df = spark.createDataFrame([(*r, None) for r in rows], "package_no string, completeness int, seq bigint, value_inr bigint, client_name string")
    for chunk in (4, merge.CHUNK_ROWS):
        assert pairs(merge.merge_records(df, chunk_rows=chunk), "package_no", "value_inr") == [
            ("edge", edge + 1800), ("far", 7), ("none", None), ("zero", 5),
        ]


def test_merge_of_one_long_run_and_of_records_without_a_key(spark):
    rng = random.Random(3)
    values = [10**6 + 400 * i for i in range(20_000)]
    rng.shuffle(values)
    rows = [("run", rng.randrange(3), i, v, None) for i, v in enumerate(values)]
    rows += [(None, 1, 30_000, 900, None), (None, 2, 30_001, 500, "C")]
    cols = ["package_no", "completeness", "seq", "value_inr", "client_name"]
    df = spark.createDataFrame(rows, "package_no string, completeness int, seq bigint, value_inr bigint, client_name string").repartition(4)
    want = _fold([dict(zip(cols, r)) for r in rows if r[0]])[0]
    got = {r["package_no"]: (r["value_inr"], r["client_name"]) for r in merge.merge_records(df).collect()}
    assert got == {"run": (want, None), None: (500, "C")}
    assert merge.merge_records(df.limit(0)).collect() == []


def test_effects_compose_like_the_fold():
    rng = random.Random(8)
    for _ in range(300):
        values = [rng.randrange(60) for _ in range(rng.randrange(12))]
        cut = rng.randrange(len(values) + 1)
        whole = merge._effect_of(values[cut:], 4).after(merge._effect_of(values[:cut], 4))
        assert all(hi < lo for hi, lo in zip(whole.hi, whole.lo[1:]))
        for start in range(-6, 70):
            current = start
            for v in values:
                current = v if abs(v - current) <= 4 else current
            assert whole.of(start) == current == merge._effect_of(values, 4).of(start)


def test_canonical_spelling_prefers_mixed_case(spark):
    works = spark.createDataFrame([("ACME LTD",), ("Zed",), ("beta",)], "n string")
    ledger = spark.createDataFrame([("Acme Ltd",), ("ZED",), ("Beta",), ("nan",)], "n string")
    spellings = merge.canonical_spellings([(works, "n"), (ledger, "n")])
    assert pairs(spellings, "key", "canonical") == [("acme ltd", "Acme Ltd"), ("beta", "beta"), ("zed", "Zed")]
    assert pairs(merge.apply_canonical(works, "n", spellings), "n") == [("Acme Ltd",), ("Zed",), ("beta",)]


def test_upsert_unique_and_backfill(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, v int, seq int")
    assert pairs(merge.latest_per_key(df, "k", "seq"), "k", "v") == [("a", 2), ("b", 3)]
    with pytest.raises(ValueError):
        merge.require_unique(df, "k")
    engineers = spark.createDataFrame([("E2", "Asha Nair"), ("E1", "ASHA NAIR")], "emp_id string, name string")
    works = spark.createDataFrame([("d1", "asha nair"), ("d2", None), ("d3", "X")], "doc_id string, lead_engineer string")
    assert pairs(merge.backfill_lead_ids(works, engineers), "doc_id", "lead_engineer_id") == [
        ("d1", "E1"), ("d2", None), ("d3", None),
    ]


# --- containment and resolution ----------------------------------------------------------------------


def test_contained_names_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["ab", "Abc", "c", "road", "roads", "x-ray", "Überweg", "a.b", "dé", "public works", "q"]
    texts = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", "", "-", ", "]) for _ in range(12))) for i in range(60)]
    names = sorted(
        {"".join(rng.choice(vocabulary) + rng.choice([" ", "", "-"]) for _ in range(rng.randrange(1, 5))) for _ in range(80)}
        | {"b", "c road", "public works", "a.b", "ROAD"}
    )
    t = spark.createDataFrame(texts, "qid int, question string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = pairs(contained_names(t, n, "qid", "question", "name"), "qid", "name")
    assert got == sorted((i, x) for i, text in texts for x in names if x.lower() in text.lower())
    whole = pairs(contained_names(t, n, "qid", "question", "name", whole_words=True), "qid", "name")
    import re

    def bounded(x, text):
        return re.search(rf"\b{re.escape(x.lower())}\b", text.lower()) is not None

    assert whole == sorted((i, x) for i, text in texts for x in names if bounded(x, text))


CLIENTS = [
    "Public Works Department, Govt of Maharashtra", "Public Works Department, Govt of Gujarat",
    "Irrigation & Waterways Dept, Govt of Uttar Pradesh", "Jal Nigam, Uttar Pradesh", "Mahanadi Steel Corporation",
]


def test_resolve_tiers(spark):
    asked = [
        (1, "what about Mahanadi Steel Corporation today"), (2, "the Maharashtra PWD total"), (3, "steel works near the river"),
        (4, "PWD totals"), (5, "nothing fits here"), (6, "waterways in uttar pradesh"), (7, None),
    ]
    q = spark.createDataFrame(asked, "qid int, question string")
    c = spark.createDataFrame([(x,) for x in CLIENTS], "name string")
    got = {r["qid"]: r for r in rs.resolve(q, c, "name").collect()}
    assert (got[1]["matched"], got[1]["method"], got[1]["confidence"]) == (CLIENTS[4], "exact", 1.0)
    assert (got[2]["matched"], got[2]["method"]) == (CLIENTS[0], "fuzzy")  # an acronym tie broken by the state
    assert (got[3]["matched"], got[3]["method"]) == (CLIENTS[4], "fuzzy")
    assert got[4]["matched"] is None and got[4]["tied"] == sorted(CLIENTS[:2]) and got[4]["method"] == "acronym"
    assert got[5]["method"] == "none" and got[5]["tied"] == []
    assert got[6]["matched"] == CLIENTS[2]
    assert got[7]["method"] == "none"
    for r in got.values():
        assert not (r["matched"] and r["tied"])


def test_project_resolution_and_override(spark):
    works = spark.createDataFrame(
        [("d1", "Ring Road — Gujarat Pkg-1", "Pkg-1", "C1", "E1"), ("d2", "Check Dam — Bihar Pkg-2", "Pkg-2", "C2", "E1"),
         ("d3", "Rail Tunnel — Bihar Pkg-3", "Pkg-3", "C1", "E2")],
        "doc_id string, project_name string, package_no string, client_name string, lead_engineer string",
    )
    cats = spark.createDataFrame([("tunnels",)], "category string")
    q = spark.createDataFrame(
        [(1, "the Package 2 work", None, None), (2, "the check dam job", "E1", None), (3, "rail tunnels in bihar", None, "C1")],
        "qid int, question string, scope_engineer string, scope_client string",
    )
    got = {r["qid"]: (r["matched"], r["method"]) for r in rs.resolve_project(q, works, cats).collect()}
    assert got == {1: ("Check Dam — Bihar Pkg-2", "exact"), 2: ("Check Dam — Bihar Pkg-2", "fuzzy"), 3: ("Rail Tunnel — Bihar Pkg-3", "fuzzy")}
    resolved = spark.createDataFrame(
        [(1, "C1", [], "Check Dam — Bihar Pkg-2", "exact"), (2, None, ["C1", "C2"], "Check Dam — Bihar Pkg-2", "fuzzy"),
         (3, "C1", [], "Check Dam — Bihar Pkg-2", "fuzzy"), (4, "C1", [], None, "none")],
        "qid int, client string, client_tied array<string>, project string, project_method string",
    )
    assert pairs(rs.override_client(resolved, works), "qid", "client") == [(1, "C2"), (2, "C2"), (3, "C1"), (4, "C1")]


def test_scope_decision(spark):
    rows = [
        (1, "combined value of all works", "C", "E", "P", None), (2, "mean against median", None, "E", None, None),
        (3, "combined value", "C", "E", None, None), (4, "value of it", "C", None, "P", None),
    ]
    df = spark.createDataFrame(rows, "qid int, question string, client string, engineer string, project string, cred_type string")
    got = pairs(classify.scope_decision(classify.flag_questions(df)), "qid", "scope", "scope_kind", "engineer_is_filter")
    assert got == [(1, "C", "client", False), (2, "E", "engineer", False), (3, None, None, True), (4, None, None, False)]


def test_category_spans(spark):
    df = spark.createDataFrame([("large bridges and flyovers, broads, roads and drainage",)], "q string")
    assert df.select(linking.category_spans("q")).first()[0] == ["bridges and flyovers", "roads", "drainage"]


# --- classification and extraction --------------------------------------------------------------------


def test_document_classes(spark):
    cases = {
        "Compliance checklist ... completion certificate": "unknown", "Tender dossier PMP": "unknown",
        "x" * 500 + " checklist pmp": "personnel_certificate", "Six Sigma Black Belt": "personnel_certificate",
        "Curriculum Vitae": "cv", "To whomsoever it may concern": "reference_letter",
        "Completion Certificate": "completion_certificate_any", "completion": "unknown", None: "unreadable",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, page1 string")
    got = [r["cls"] for r in classify.classify_pages(df).orderBy("i").collect()]
    assert got == list(cases.values())
    assert classify.tabular_class(["Invoice No", "Outstanding (INR)"]) == "receivables_ageing"
    assert classify.tabular_class(["Asset ID"]) == "plant_machinery_register"
    assert classify.tabular_class(["a"], "Plant Register") == "plant_machinery_register"
    assert classify.tabular_class(["a"]) == "unknown"


SAMPLE_WORDING = [
    ("how many works have no client reference letter on file?", "count", "absence"),
    ("how many different categories of work has he led?", "count", "distinct_count"),
    ("exact interval from issuance to completion", "days", "date_span"),
    ("combined value of every completed assignment", "money", "hop_aggregate"),
    ("combined value of only the projects that wrapped up after that date", "money", "temporal_chain"),
    ("the defensible average size across all completed projects", "money", "avg_work_size"),
    ("excluding buildings, what is the aggregate value", "money", "exclusion_aggregate"),
    ("how much additional work must we secure to reach our credential target of INR 20 Cr?", "money", "gap_to_threshold"),
    ("by how much does the largest completed work exceed the second largest?", "money", "rank_value"),
    ("what share carries formal verification on file?", "percent", "referenced_share"),
    ("works crossing the seventy-three crore mark before the deadline", "money", "threshold_aggregate"),
    ("contracts hitting the six crore line", "money", "threshold_aggregate"),
    ("percent collected of what was billed", "percent", "collection_rate"),
    ("average minus median", "money", "mean_vs_median"),
    ("how much do they still owe", "money", "outstanding_balance"),
    ("compare 2015 with 2018", "money", "annual_diff"),
    # substring counting: one phrase alone yields two terms
    ("value of roads highways", "money", "category_diff"),
    ("gap between awards and what was invoiced", "money", "billing_shortfall"),
    ("anything across the line item", "money", "hop_aggregate"),
]


def test_question_shapes(spark):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(SAMPLE_WORDING)], "i int, question string, answer_type string, expected string")
    wrong = classify.with_shape(df).filter("shape <> expected").select("question", "shape", "expected").collect()
    assert wrong == []


CERTIFICATES = {
    "DOC-1": ["OFFICE OF ROADS\nCompletion Certificate\nName of Work\nRing Road – Assam Pkg-7\nNature / Category\nRoads / Highways\n"
              "Contract Value (Original)\n19.33 Cr\nCompletion Date\nApril 22, 2011\nContractor's Project Manager\nNeha Chopra\n"
              "Client Certificate Ref\nCC/1\nInternal Ref: IR-9\nClient\nRoads Office (Govt)\n", "Contract Value INR 19,32,99,999/-"],
    "DOC-2": ["BODY\nthe work of ‘Check Dam - Pkg-8’ (water supply), completed in all respects on 2015-01-12 at a gross "
              "executed value of INR 2,00,000/- and supervised on the contractor's side by Ravi Rao."],
    "DOC-3": ["NO PACKAGE\nWork\nSome Road\nExecuted Value\n5 Cr\n"],
    "DOC-4": ["NO VALUE\nWork\nRoad Pkg-9\nExecuted Value\nnil\n"],
}


def test_certificates(spark):
    rows = [(d, n + 1, t) for d, ps in CERTIFICATES.items() for n, t in enumerate(ps)]
    docs = extract.document_texts(spark.createDataFrame(rows, "doc_id string, page_no int, text string"))
    got = {r["doc_id"]: r for r in extract.certificate_records(docs).collect()}
    assert set(got) == {"DOC-1", "DOC-2"}
    a, b = got["DOC-1"], got["DOC-2"]
    assert (a["package_no"], a["project_name"], a["client_name"]) == ("Pkg-7", "Ring Road — Assam Pkg-7", "Roads Office")
    assert (a["value_inr"], a["category"], a["state"]) == (193299999, "roads highways", "Assam")
    assert (a["client_cert_ref"], a["internal_ref"], a["completeness"]) == ("CC/1", "IR-9", 4)
    assert a["completion_date"] == datetime.date(2011, 4, 22)
    assert (b["client_name"], b["value_inr"], b["lead_engineer"]) == ("BODY", 200000, "Ravi Rao")
    assert b["completion_date"] == datetime.date(2015, 1, 12)


def test_letters_keep_the_unmatched_and_the_last(spark):
    docs = spark.createDataFrame(
        [("L1", "HEAD\nabout PKG-7"), ("L2", "HEAD\nabout pkg7"), ("L3", "HEAD\nabout Pkg-99"), ("L4", "HEAD\nnone")],
        "doc_id string, page1 string",
    )
    works = spark.createDataFrame([("W1", "P", "Pkg-7"), ("W2", "Q", "Pkg-8")], "doc_id string, project_name string, package_no string")
    matched = merge.match_letters(extract.letter_records(docs), works)
    assert pairs(matched, "doc_id", "matched_project_doc_id") == [("L1", "W1"), ("L2", "W1"), ("L3", None), ("L4", None)]
    flagged = merge.flag_references(works, matched)
    assert pairs(flagged, "doc_id", "has_reference_letter", "ref_letter_doc_id") == [("W1", True, "L2"), ("W2", False, None)]


# --- worked examples: operand values -> stated answer ---------------------------------------------------

EXAMPLES = [
    ("hop_aggregate", [193299999, 176600000, 214200000, 307300000, 586900000, 529900000], None, 2008199999),
    ("hop_aggregate", [98000000, 182600000, 318900000, 149200000, 161700000, 977200000, 56700000], None, 1944300000),
    ("avg_work_size", [730200000, 814400000, 69200000], None, 537933333),
    ("avg_work_size", [209200000, 467299999, 12000000], None, 229500000),
    ("gap_to_threshold", [123300000, 48000000], "20 Cr", 28700000),
    ("rank_value", [730200000, 814400000, 69200000], None, 84200000),
    ("rank_value", [87400000, 314600000, 69500000], None, 227200000),
    ("threshold_aggregate", [730200000, 814400000, 69200000], "73 Cr", 1544600000),
    ("threshold_aggregate", [573700000, 60800000, 19000000], "6 Cr", 634500000),
    ("exclusion_aggregate", [403700000, 746600000, 16700000], 0, 763300000),
    ("exclusion_aggregate", [87400000, 314600000, 69500000], 2, 402000000),
    ("temporal_chain", [135600000, 449000000, 69200000], [1, 2], 518200000),
    ("temporal_chain", [321400000, 214200000, 814400000, 30000000], [1, 3], 244200000),
    ("absence", [134000000, 23300000], 1, 1),
    ("absence", [730200000, 814400000, 69200000], 2, 2),
    ("referenced_share", [1, 2, 3], 2, 33.33),
    ("referenced_share", [1, 2, 3], 1, 66.67),
    ("distinct_count", [210400000, 149200000, 2000000000], None, 3),
    ("distinct_count", [321400000, 214200000, 814400000, 30000000], None, 4),
]
WORDING = {
    "hop_aggregate": "combined value of every completed work for {c}?",
    "avg_work_size": "{c}: the average size across all completed projects?",
    "gap_to_threshold": "{c}: how much additional work to reach {p}?",
    "rank_value": "{c}: by how much does the largest exceed the second largest?",
    "threshold_aggregate": "{c}: their works crossing the {p} mark?",
    "exclusion_aggregate": "{c}; excluding tunnels, the value?",
    "temporal_chain": "what did {e} deliver, completed after the certification date of March 10, 2021?",
    "absence": "{c}: how many works lack a letter?",
    "referenced_share": "{c}: share with a reference letter?",
    "distinct_count": "how many kinds of work has {e} led?",
}
KIND = {"absence": "count", "distinct_count": "count", "referenced_share": "percent"}


def test_worked_examples_end_to_end(spark):
    """Every example becomes a client, its works and a question; linked and answered in one batch."""
    works, engineers, questions = [], [], []
    old, new = datetime.date(2020, 1, 1), datetime.date(2022, 1, 1)
    for i, (shape, operands, param, _) in enumerate(EXAMPLES):
        client, lead = f"Client Number {i:02d}", f"First{'abcdefghijklmnopqrs'[i]} Last{'abcdefghijklmnopqrs'[i]}"
        engineers.append((f"E{i:02d}", lead))
        for j, value in enumerate(operands):
            category = "tunnels" if shape == "exclusion_aggregate" and j == param else f"kind {'abcdefg'[j]}"
            done = new if shape == "temporal_chain" and j in param else old
            unreferenced = shape in ("absence", "referenced_share") and j < param
            n = i * 100 + j
            works.append((f"D{n}", f"Work Pkg-{n}", client, category, value, done, lead, f"Pkg-{n}", not unreferenced))
        questions.append((f"Q{i:02d}", WORDING[shape].format(c=client, e=lead, p=param), KIND.get(shape, "money")))
    w = spark.createDataFrame(
        works, "doc_id string, project_name string, client_name string, category string, value_inr bigint, "
        "completion_date date, lead_engineer string, package_no string, has_reference_letter boolean",
    )
    e = spark.createDataFrame(engineers, "emp_id string, name string")
    certs = spark.createDataFrame([], "doc_id string, name string, emp_id string, cred_type string, cred_id string, issue_date date")
    ledger = spark.createDataFrame([], "client_name string, invoiced_inr bigint, received_inr bigint, outstanding_inr bigint")
    q = spark.createDataFrame(questions, "qid string, question string, answer_type string")
    linked = linking.link_questions(q, w, e, certs, w.select("client_name").distinct())
    got = {r["qid"]: (r["shape"], float(r["answer"])) for r in answer_questions(linked, w, ledger, certs).collect()}
    assert got == {f"Q{i:02d}": (shape, float(answer)) for i, (shape, _, _, answer) in enumerate(EXAMPLES)}


def test_links_by_stronger_evidence(spark):
    d = datetime.date
    works = spark.createDataFrame(
        [("D1", "Ring Road — Gujarat Pkg-1", "Alpha Board", "roads highways", 1, d(2020, 1, 1), "Asha Nair", "Pkg-1", True),
         ("D2", "School Building — Bihar Pkg-2", "Beta Board", "small buildings", 2, d(2020, 2, 1), "Asha Bose", "Pkg-2", True),
         ("D3", "Check Dam — Kerala Pkg-3", "Beta Board", "irrigation", 3, d(2020, 3, 1), "Ravi Rao", "Pkg-3", True)],
        "doc_id string, project_name string, client_name string, category string, value_inr bigint, completion_date date, "
        "lead_engineer string, package_no string, has_reference_letter boolean",
    )
    engineers = spark.createDataFrame([("E1", "Asha Nair"), ("E2", "Asha Bose"), ("E3", "Ravi Rao")], "emp_id string, name string")
    certs = spark.createDataFrame(
        [("C1", "Ravi Rao", "E3", "PMP", "PMI-77", d(2019, 1, 1)), ("C2", "Guest Holder", None, "PMP", "PMI-88", d(2018, 1, 1))],
        "doc_id string, name string, emp_id string, cred_type string, cred_id string, issue_date date",
    )
    asked = [
        ("full", "what did Asha Nair do"), ("first", "what did ravi do"), ("namesake", "asha's school building in bihar"),
        ("ambiguous", "what did asha do"), ("holder", "what did Guest Holder do"), ("cert", "Asha Nair under pmi-77"),
        ("package", "Asha Nair on package 3"), ("alias", "ask the bee board"), ("excl", "Alpha Board; excluding small building works"),
        ("none", "hello"),
    ]
    q = spark.createDataFrame(asked, "qid string, question string")
    linked = linking.link_questions(
        q, works, engineers, certs, works.select("client_name").distinct(), [("bee board", "Beta Board")], [("ash b", "Asha Bose")]
    )
    got = {r["qid"]: r for r in linked.collect()}
    assert {k: got[k]["engineer"] for k in got} == {
        "full": "Asha Nair", "first": "Ravi Rao", "namesake": "Asha Bose", "ambiguous": None, "holder": "Guest Holder",
        "cert": "Ravi Rao", "package": "Ravi Rao", "alias": None, "excl": None, "none": None,
    }
    assert got["full"]["package_no"] == "Pkg-1" and got["full"]["client_name"] == "Alpha Board"  # sole work
    assert got["package"]["project_doc_id"] == "D3" and got["cert"]["issue_date"] == d(2019, 1, 1)
    assert got["alias"]["client_name"] == "Beta Board"
    assert got["excl"]["excluded_category"] == "small buildings"
    assert got["none"]["client_name"] is None


# --- invariants -------------------------------------------------------------------------------------------


def test_portfolio_invariants(spark):
    from folioscope.plans import views as v

    works = v.flagged_works(spark, "/root/testdata/sf0.001")
    stats = {r[0]: r for r in portfolio.client_works(works).select("client_name", "n_works", "awarded", "n_referenced", "n_unreferenced").collect()}
    assert all(r["n_referenced"] + r["n_unreferenced"] == r["n_works"] for r in stats.values())
    cats = portfolio.category_totals(works).groupBy("client_name").agg(F.sum("category_total").alias("t")).collect()
    assert all(stats[r["client_name"]]["awarded"] == r["t"] for r in cats)
    for r in portfolio.exclusion_totals(works).join(portfolio.category_totals(works), ["client_name", "category"]).collect():
        assert r["exclusion_total"] + r["category_total"] == stats[r["client_name"]]["awarded"]


def test_exclusion_keeps_works_without_a_category(spark):
    works = spark.createDataFrame(
        [("A", "tunnels", 1), ("A", None, 10), ("A", "", 100), ("A", "roads", 1000), ("B", "nan", 5)],
        "client_name string, category string, value_inr bigint",
    )
    got = pairs(portfolio.exclusion_totals(works), "client_name", "category", "exclusion_total")
    assert got == [("A", "(none)", 1001), ("A", "roads", 111), ("A", "tunnels", 1110), ("B", "(none)", 0)]


def test_title_overlap_matches_brute_force(spark):
    rng = random.Random(9)
    kinds, places = ["Ring Road", "Road Widening", "Check Dam", "Rail Tunnel Road"], ["Assam", "Bihar", "West Bengal"]
    works = [
        (f"D{i:03d}", f"{rng.choice(kinds)} — {rng.choice(places)} Pkg-{100 + i}", rng.choice(["Asha Nair", "Ravi Rao", None]))
        for i in range(120)
    ]
    texts = [
        (q, " ".join(rng.choice(["ring", "roads", "dam", "assam", "bengal", "west", "101", "tunnels", "x", "117"]) for _ in range(4)))
        for q in range(40)
    ]
    w = spark.createDataFrame(works, "doc_id string, project_name string, lead_engineer string")
    t = spark.createDataFrame(texts, "qid int, question string")
    p = spark.createDataFrame([(q, lead) for q, _ in texts for lead in ("asha nair", "ravi rao")], "qid int, lead string")
    group_words, own_words = linking.title_index(w)
    words = group_words.select("word").union(own_words.select("word"))
    hits = linking.contained_words(t, words, "qid", "question", "word")
    best = linking.title_overlap(hits, p, group_words, own_words).groupBy("qid", "lead").agg(
        F.min_by("doc_id", F.struct(-F.col("score"), F.col("doc_id"))).alias("doc_id"), F.max("score").alias("score")
    )
    expected = []
    for q, text in texts:
        for lead in ("asha nair", "ravi rao"):
            scored = []
            for d, title, who in works:
                if who and who.lower() == lead:
                    ws = [x for x in title.lower().replace("-", " ").split() if len(x) > 2 and x not in ("package", "pkg")]
                    scored.append((-sum(x in text for x in ws), d))
            score, doc = min(scored)
            if score <= -2:
                expected.append((q, lead, doc, -score))
    assert pairs(best, "qid", "lead", "doc_id", "score") == sorted(expected)


def test_ranks_and_medians_keep_missing_keys_and_values(spark):
    rows = [("a", 5, 1), ("a", None, 2), (None, 7, 3), (None, 9, 4), ("a", 2_000_000, 5)]
    df = spark.createDataFrame(rows, "k string, v long, id long")
    got = {r["id"]: r["rank"] for r in ranking.rank_descending(df, ["k"], "v", "id").collect()}
    assert got == {5: 1, 1: 2, 2: 3, 4: 1, 3: 2}
    medians = {r["k"]: (r["n"], r["median"]) for r in ranking.exact_median(df, ["k"], "v").collect()}
    assert medians == {"a": (2, 1_000_002.5), None: (2, 8.0)}


def test_acronym_classes_keep_every_hit(spark):
    names = [f"{a} {b} Works{c}" for a in ("Public", "Port") for b in ("Water", "Way", "Rail") for c in ("", ", Delhi", " of Pune")]
    catalog = spark.createDataFrame([("", x) for x in [*names, *names[:3], "", "x"]], f"{rs.POOL} string, name string")
    members = rs.acronym_classes(catalog)
    assert sorted(r["name"] for r in members.collect()) == sorted(names)
    asked = [(1, "pww and prw of PWWOP"), (2, "PWW"), (3, "none"), (4, None), (5, "pwwd pwwd")]
    q = spark.createDataFrame([("", *x) for x in asked], f"{rs.POOL} string, qid int, question string")
    hits = rs.acronym_class_hits(q, members).join(members, [rs.POOL, "class"])
    spelled = {r["name"]: r["a"] for r in catalog.select("name", tx.acronyms("name").alias("a")).collect()}
    want = {(i, t, n) for i, text in asked for t in set((text or "").upper().split()) for n in names if t in spelled[n]}
    got = [(r["qid"], r["acronym"], r["name"]) for r in hits.collect()]
    assert len(got) == len(set(got)) and set(got) == want and {i for i, *_ in got} >= {1, 2, 5}
    settled = {r["qid"]: r for r in rs.resolve(q.drop(rs.POOL), catalog.drop(rs.POOL), "name").collect()}
    assert settled[2]["method"] == "acronym" and settled[2]["tied"] == sorted(n for n in names if "PWW" in spelled[n])
