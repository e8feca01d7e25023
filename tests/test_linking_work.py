"""What linking reads and compares: titles only for questions that may need them, rare kinds of anchor in one pass."""

import datetime

from pyspark.sql import functions as F

from folioscope.operators import containment, linking

WORK = (
    "doc_id string, project_name string, client_name string, category string, value_inr bigint, completion_date date, "
    "lead_engineer string, package_no string"
)
CERT = "doc_id string, name string, cred_type string, cred_id string, issue_date date"


def test_titles_are_searched_for_questions_about_people_only(spark, monkeypatch):
    day = datetime.date(2020, 1, 1)
    rows = [("D1", "Ring Road Gujarat Pkg-101", "Alpha Board", "roads", 1, day, "Asha Nair", "Pkg-101"),
            ("D2", "Check Dam Kerala Pkg-102", "Beta Board", "irrigation", 2, day, "Asha Nair", "Pkg-102"),
            ("D3", "Check Dam Bihar Pkg-103", "Beta Board", "irrigation", 2, day, "Ravi Rao", "Pkg-103")]
    works = spark.createDataFrame(rows, WORK)
    engineers = spark.createDataFrame([("E1", "Asha Nair"), ("E2", "Ravi Rao")], "emp_id string, name string")
    certs = spark.createDataFrame([], CERT)
    clients = [(f"c{i}", f"the check dam and ring road of Beta Board, part {i}") for i in range(20)]
    people = [("p1", "the check dam of Asha Nair"), ("p2", "Asha Nair on package 101"), ("p3", "what did ravi do")]
    asked = spark.createDataFrame(clients + people, "qid string, question string")
    searched, indexed = [], []
    words, index = linking.contained_words, linking.title_index

    def search(texts, *args):
        searched.extend(r["qid"] for r in texts.collect())
        return words(texts, *args)

    def build(rows, *wanted):
        found = index(rows, *wanted)
        indexed.extend(r["word"] for part in found for r in part.collect())
        return found

    monkeypatch.setattr(linking, "contained_words", search)
    monkeypatch.setattr(linking, "title_index", build)
    got = {r["qid"]: r for r in linking.link_questions(asked, works, engineers, certs, works.select("client_name").distinct(), [], []).collect()}
    assert sorted(searched) == ["p1", "p3"] and set(indexed) == {"check", "dam"}
    assert {q: (got[q]["engineer"], got[q]["project_doc_id"]) for q in ("p1", "p2", "p3", "c0")} == {
        "p1": ("Asha Nair", "D2"), "p2": ("Asha Nair", "D1"), "p3": ("Ravi Rao", "D3"), "c0": (None, None),
    }
    assert {got[f"c{i}"]["client_name"] for i in range(20)} == {"Beta Board"} and len(got) == 23


def test_rare_kinds_of_anchor_share_one_pass(spark, monkeypatch):
    """A catalog of a few short names has many kinds; each was a pass over all texts."""
    names = spark.createDataFrame([(x,) for x in ("ab cd", "abc def", "abcd efgh", "x", "yy", "up irrigation", "Uma S.")], "name string")
    texts = spark.createDataFrame([(1, "XAB CDX"), (2, "an abc  def"), (3, "uma s. up irrigations"), (4, None), (5, "yy")], "qid int, question string")
    plain = sorted(map(tuple, containment.contained_names(texts, names, "qid", "question", "name").collect()))
    whole = sorted(map(tuple, containment.contained_names(texts, names, "qid", "question", "name", whole_words=True).collect()))

    def no_pass(*_):
        raise AssertionError("a pass for each kind")

    monkeypatch.setattr(containment, "_text_anchors", no_pass)
    assert sorted(map(tuple, containment.contained_names(texts, names, "qid", "question", "name", literal=True).collect())) == plain
    found = containment.contained_names(texts, names, "qid", "question", "name", whole_words=True, literal=True)
    assert sorted(map(tuple, found.collect())) == whole
    assert plain == [(1, "ab cd"), (1, "x"), (3, "Uma S."), (3, "up irrigation"), (5, "yy")] and whole == [(5, "yy")]


def test_words_that_begin_in_no_token_get_no_anchors(spark, monkeypatch):
    words = spark.createDataFrame([(str(i),) for i in range(1000, 3000)] + [("bridge",), ("Ring",)], "word string")
    texts = spark.createDataFrame([(1, "a drainbridge rings"), (2, "pkg-120077"), (3, None)], "qid int, question string")
    seen, options = [], containment._name_options

    def chosen(names, *args):
        seen.append(names.count())
        return options(names, *args)

    monkeypatch.setattr(containment, "_name_options", chosen)
    got = containment.contained_words(texts, words, "qid", "question", "word")
    assert sorted(map(tuple, got.collect())) == [(1, "Ring"), (1, "bridge"), (2, "1200"), (2, "2007")]
    assert seen == [4]
    assert got.filter(F.col("qid") == 3).count() == 0
