"""Scalar goldens: literal inputs and the values they must give."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.functions import dates, money, numeric, tableqa, text as tx
from folioscope.operators import scoring


def values(spark, inputs, fn, type_="string"):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_parse_money(spark):
    cases = {
        "INR 33.38 Cr": 333800000, "3,338.00 Lakh": 333800000, "33,38,00,000": 333800000,
        "333800000": 333800000, "INR 19,32,99,999/-": 193299999, "Rs. 18.26 Crore": 182600000,
        "200.00 Cr": 2000000000, "INR 450.5 Lakhs": 45050000, "1,944,300,000": 1944300000,
        # edge rows: commas before a unit, the Rs. prefix, a sign
        "INR 1,234.50 Cr": 12345000000, "Rs. 33,38,00,000": 333800000, "-500": -500,
        "INR -1,00,000": -100000, "": 0, "nothing": 0, None: 0, "0.5": 0, "2.5": 2, "₹ 12": 12,
        "INR\n20 Cr": 200000000, "12.3.4": 0,
    }
    assert values(spark, list(cases), money.parse_money) == list(cases.values())


def test_money_from_number(spark):
    got = values(spark, [1.5, 2.5, -500.0, float("nan"), None], money.money_from_number, "double")
    assert got == [2, 2, -500, 0, 0]


def test_threshold(spark):
    cases = {
        "forty crore": 400000000, "twenty-three crore": 230000000, "INR 20 Cr": 200000000,
        "43 crore": 430000000, "6 crore": 60000000, "23.0 Cr": 230000000, "70cr": 700000000,
        "120 Cr": 1200000000, "the seventy-three crore mark": 730000000, "12.5 lakhs": 1250000,
        "one hundred twenty crore": 200000000, "across the deadline": 0,
    }
    assert values(spark, list(cases), money.threshold_rupees) == list(cases.values())


def test_words_to_number(spark):
    assert values(spark, ["seventy-three", "forty", "Twenty six", "none"], money.words_to_number) == [73, 40, 26, 0]


def test_indian_grouping(spark):
    got = values(spark, [5, 999, 1000, 12345, 333800000, -13279236], money.indian_grouping, "bigint")
    assert got == ["5", "999", "1,000", "12,345", "33,38,00,000", "-1,32,79,236"]


def test_parse_date(spark):
    d = datetime.date
    cases = {
        "06/02/2011": d(2011, 2, 6), "31/03/2026": d(2026, 3, 31), "2021-03-10": d(2021, 3, 10),
        "January 12, 2015": d(2015, 1, 12), "12 January 2015": d(2015, 1, 12), "06 Feb 2011": d(2011, 2, 6),
        "6-2-2011": d(2011, 2, 6), "Feb 6 2011": d(2011, 2, 6), "2021/3/1": d(2021, 3, 1),
        "MARCH 1, 2020": d(2020, 3, 1), "on 2021-03-10, noon": d(2021, 3, 10), "by 10/03/2021.": d(2021, 3, 10),
        "2021-13-45": None, "soon": None, "": None, None: None, "2021": None, "30 Foo 2020": None,
    }
    assert values(spark, list(cases), dates.parse_date) == list(cases.values())


def test_date_in_text(spark):
    asked = ["issued March 10, 2021 to him", "dated 2021-03-10", "in 2021"]
    got = values(spark, asked, lambda c: dates.parse_date(dates.written_date(c)))
    assert got == [datetime.date(2021, 3, 10), datetime.date(2021, 3, 10), None]


def test_days_between(spark):
    df = spark.createDataFrame([("2021-03-10", "2016-11-22"), (None, "2020-01-01"), ("x", "2020-01-01")], "a string, b string")
    assert [r[0] for r in df.select(dates.days_between("a", "b")).collect()] == [1569, 0, 0]


def test_percent(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 0), (None, 5), (5, None)], "n int, d int")
    assert [r[0] for r in df.select(numeric.percent("n", "d")).collect()] == [33.33, 66.67, 0.0, 0.0, 0.0]


def test_names(spark):
    assert values(spark, ["a – b � c\n d", None], tx.normalize_text) == ["a — b — c d", ""]
    assert values(
        spark, ["  ACME  (Govt) Ltd (x)", "Irrigation & Waterways Dept, Govt of West"], tx.clean_client_name
    ) == ["ACME Ltd", "Irrigation & Waterways Dept, Govt of West Bengal"]
    assert values(spark, ["Roads / Highways", None], tx.clean_category) == ["roads highways", ""]
    assert values(spark, ["Ring Road pkg12 x", "none"], tx.package_number) == ["Pkg-12", None]
    assert values(spark, ["Package 51", "pkg - 7", "none"], tx.package_mention) == ["Pkg-51", "Pkg-7", None]
    # list order decides, not text order
    assert values(spark, ["West Bengal near assam", "nowhere"], tx.state_name) == ["Assam", None]
    assert values(spark, ["of pmi-200029.", "x"], tx.credential_id) == ["PMI-200029", None]
    assert values(spark, ["in 2019, 2012 and 2019, not 1999"], tx.years_in) == [[2012, 2019]]
    assert values(spark, ["\n  \n Head line \nbody", "\n"], tx.first_line) == ["Head line", None]
    assert values(spark, ["/a/b/DOC-CC-1.x.pdf", "plain", ".hidden"], tx.doc_id_from_path) == ["DOC-CC-1.x", "plain", ".hidden"]
    assert values(spark, ["2015", "x", "", None, "12.0"], tx.digits_or_zero) == [2015, 0, 0, 0, 0]
    assert values(spark, [" nan ", "NaN", "", None, " x "], tx.blank_to_null) == [None, None, None, None, "x"]
    assert values(spark, ["Asha Nair"], tx.first_name) == ["asha"]
    assert values(spark, ["Ring Road – West-Bengal Pkg-107"], tx.title_words) == [["ring", "road", "west", "bengal", "107"]]


def test_word_sets_and_acronyms(spark):
    assert values(spark, ["Bridges of the Public Works Dept, gas"], tx.name_words) == [["bridge", "public", "work", "gas"]]
    got = values(spark, ["Public Works Department, Govt of Maharashtra"], tx.acronyms)
    assert got == [sorted({"PWDGOM", "PWM", "PWD", "PW", "GOM"})]
    assert values(spark, ["I'm up for the PWD in mah"], tx.acronym_tokens) == [["PWD", "MAH"]]


def test_table_questions(spark):
    df = spark.range(1).select(
        tableqa.format_table(F.expr("array(array('a','b'),array('1','2'))")).alias("t"),
        tableqa.format_paragraphs(
            F.expr("array(named_struct('order',2,'text','two'),named_struct('order',CAST(NULL AS INT),'text','zero'),named_struct('order',1,'text','one'))")
        ).alias("p"),
    )
    assert tuple(df.first()) == ("a | b\n1 | 2", "zero\none\ntwo")


@pytest.mark.parametrize(
    "operands, op, expected",
    [
        ([5.0, 3.0], "subtract", 2.0), ([5.0, 4.0], "percent_change", 25.0), ([5.0, 0.0], "percent_change", 5.0),
        ([1.0, 2.0, 3.5], "sum", 6.5), ([1.0, 2.0], "average", 1.5), ([1.0, 3.0], "divide", 0.3333),
        ([1.0, 0.0], "divide", 1.0), ([2.0, 3.0, 4.0], "multiply", 24.0), ([7.0], "none", 7.0),
        ([7.0], "subtract", 7.0), ([], "sum", None),
    ],
)
def test_arithmetic(spark, operands, op, expected):
    df = spark.createDataFrame([(operands, op)], "xs array<double>, op string")
    assert df.select(tableqa.arithmetic("xs", "op")).first()[0] == expected


def test_proportional_score(spark):
    cases = [
        (1e9, 1e9, 1.00), (1e9, 1.05e9, 0.95), (1e9, 0.95e9, 0.95), (1e9, 1.5e9, 0.50), (1e9, 2e9, 0.00),
        (1e9, 5e9, 0.00), (100.0, 99.0, 0.99), (5.0, 5.0, 1.00), (5.0, 4.0, 0.80), (66.67, 66.67, 1.00),
        (66.67, 0.6667, 0.01), (1e9, None, 0.00), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0),
    ]
    df = spark.createDataFrame([(i, g, a) for i, (g, a, _) in enumerate(cases)], "i int, g double, a double")
    got = [r[0] for r in df.orderBy("i").select(scoring.proportional_score("g", "a")).collect()]
    assert all(abs(x - e) < 5e-3 for x, (_, _, e) in zip(got, cases))
