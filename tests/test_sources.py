"""Sources and sinks over small files."""

import json

import pytest

from folioscope.operators import extract, scoring
from folioscope.sources import answers, files, questions, tables


def test_questions_in_every_layout(spark, tmp_path):
    rows = [
        {"qid": "A", "question": "one?", "answer": 1, "answer_type": "count", "shape": "absence", "reasoning_steps": ["1. x"]},
        {"question_id": "B", "question_text": "two?", "answer_gold": 33.33, "answer_type": "percent", "scored": False},
    ]
    layouts = {"q.json": {"n_questions": 2, "questions": rows}, "a.json": {"answers": rows}, "l.json": rows}
    for name, content in layouts.items():
        path = tmp_path / name
        path.write_text(json.dumps(content))
        got = questions.read_questions(spark, str(path)).orderBy("pos").collect()
        assert [(r["qid"], r["question"], r["answer"], r["scored"]) for r in got] == [
            ("A", "one?", 1.0, None), ("B", "two?", 33.33, False),
        ], name
        assert got[0]["reasoning_steps"] == ["1. x"]


def test_tolerant_answers_and_scores(spark, tmp_path):
    with_header = tmp_path / "h.csv"
    with_header.write_text('note, Question_ID ,answer\nx,A,"INR 1,000"\n\nx,B,₹ 50\nx,C,n/a\nx,A,900\nx\nx, ,5\n')
    got = {r["qid"]: r["answer"] for r in answers.read_answers(spark, str(with_header)).collect()}
    assert got == {"A": 900.0, "B": 50.0, "C": None}
    bare = tmp_path / "b.csv"
    bare.write_text("A,5\nB, 6 \n")
    assert {r["qid"]: r["answer"] for r in answers.read_answers(spark, str(bare)).collect()} == {"A": 5.0, "B": 6.0}
    gold = spark.createDataFrame(
        [("A", "s1", 1000.0, None), ("B", "s1", 50.0, True), ("C", "s2", 7.0, None), ("D", "s2", 7.0, False), ("E", "s2", 1.0, None)],
        "qid string, shape string, gold double, scored boolean",
    )
    report = scoring.question_report(gold, answers.read_answers(spark, str(with_header)))
    rows = {r["qid"]: (round(r["score"], 4), r["band"]) for r in report.collect()}
    assert rows == {"A": (0.9, "CLOSE"), "B": (1.0, "OK"), "C": (0.0, "WRONG"), "E": (0.0, "WRONG")}
    totals = scoring.score_totals(report).first()
    assert (totals["answered"], totals["n"], totals["exact"]) == (2, 4, 1)
    answers.write_scored_run(report, str(tmp_path / "run"))
    written = spark.read.csv(str(tmp_path / "run"), header=True).orderBy("question_id").collect()
    assert [r["score"] for r in written] == ["0.900", "1.000", "0.000", "0.000"]


def test_submission_keeps_question_order(spark, tmp_path):
    rows = spark.createDataFrame([(2, "A", 1.5), (1, "Z", None), (3, "M", 7.0)], "pos int, question_id string, answer double")
    answers.write_submission(rows, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))
    assert text.splitlines() == ["question_id,answer", "Z,", "A,1.5", "M,7.0"]


def test_files_index_and_text(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "DOC-1.txt").write_text("Head\nCompletion Certificate\fpage two")
    (tmp_path / "a" / "b" / "DOC-2.txt").write_text("Curriculum Vitae")
    index = tmp_path / "index.csv"
    index.write_text("doc_id,doc_type,filename,size_bytes\nDOC-1,company_completion_certificate ,a/DOC-1.txt,1\nDOC-2,other,zzz/DOC-2.txt,2\nDOC-3,other,DOC-3.txt,3\n")
    found = files.list_files(spark, str(tmp_path), "*.txt")
    assert sorted(r["doc_id"] for r in found.collect()) == ["DOC-1", "DOC-2"]
    listed = files.read_index(spark, str(index))
    located = {r["doc_id"]: (r["cls"], r["path"].split(str(tmp_path))[-1]) for r in files.locate_indexed(listed, found).collect()}
    assert located == {
        "DOC-1": ("completion_certificate_any", "/a/DOC-1.txt"), "DOC-2": ("other", "/a/b/DOC-2.txt"), "DOC-3": ("other", "DOC-3.txt"),
    }
    pages = files.read_pages(spark, str(tmp_path / "a")).orderBy("page_no")
    assert [(r["doc_id"], r["page_no"], r["text"]) for r in pages.collect()] == [
        ("DOC-1", 1, "Head\nCompletion Certificate"), ("DOC-1", 2, "page two"),
    ]
    docs = extract.document_texts(pages)
    assert [r["cls"] for r in files.classify_documents(docs).collect()] == ["completion_certificate_any"]
    assert [r["cls"] for r in files.classify_documents(docs, listed).collect()] == ["completion_certificate_any"]


def test_tabular_routing_and_conform(spark, tmp_path):
    sheet = tmp_path / "ar.csv"
    sheet.write_text(
        "Invoice No,Client,Invoice Date,Invoiced (INR),Status,Received (INR),Outstanding (INR)\n"
        'I1,ACME (Govt),31/03/2026,"33,38,00,000",Open,INR 1.5 Cr,-13279236\n'
        ",ACME,31/03/2026,1,Open,1,1\nI3,nan,31/03/2026,1,Open,1,1\n"
    )
    cls, df = files.read_tabular(spark, str(sheet))
    assert cls == "receivables_ageing"
    rows = extract.conform_receivables_sheet(df).collect()
    assert [(r["invoice_no"], r["client_name"], r["invoiced_inr"], r["received_inr"], r["outstanding_inr"]) for r in rows] == [
        ("I1", "ACME", 333800000, 15000000, -13279236)
    ]
    plant = tmp_path / "plant.csv"
    plant.write_text(
        "Asset ID,Type,Make,Acquired,Cost (INR),Condition,Location,Ownership,Safety Certified\n"
        "1,Crane,ACE,2015,12 Lakh,Good,Pune,Owned,True\n2.0,Crane,ACE,n/a,500,Good,Pune,Owned,0\nx,Crane,ACE,1,1,Good,Pune,Owned,1\n"
    )
    cls, df = files.read_tabular(spark, str(plant))
    assert cls == "plant_machinery_register"
    rows = extract.conform_asset_sheet(df).orderBy("asset_id").collect()
    assert [(r["asset_id"], r["acquired_year"], r["cost_inr"], r["safety_certified"]) for r in rows] == [
        (1, 2015, 1200000, True), (2, 0, 500, False),
    ]


def test_table_documents_and_predictions(spark, tmp_path):
    docs = [
        {"table": {"table": [["a", "b"], ["1", "2"]]}, "paragraphs": [{"order": 2, "text": "y"}, {"order": 1, "text": "x"}],
         "questions": [{"uid": "u1", "question": "q1"}, {"uid": "u2", "question": "q2"}]},
        {"table": {"table": []}, "paragraphs": [], "questions": [{"uid": "u3", "question": "q3"}]},
    ]
    path = tmp_path / "d.json"
    path.write_text(json.dumps(docs))
    assert [r["uid"] for r in questions.read_table_documents(spark, str(path)).orderBy("pos").collect()] == ["u1", "u2", "u3"]
    assert [r["uid"] for r in questions.read_table_documents(spark, str(path), limit=2).collect()] == ["u1", "u2"]
    got = spark.createDataFrame([("u1", ["5"], "million"), ("u2", None, "x")], "uid string, answer array<string>, scale string")
    answers.write_predictions(got, str(tmp_path / "p"))
    back = {r["uid"]: (r["answer"], r["scale"]) for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert back == {"u1": (["5"], "million"), "u2": ([""], "")}


def test_tables_and_sql_surface(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("A", 4), ("B", 10)], "client string, v int")
    tables.refresh_tables({"works": df}, str(tmp_path))
    tables.refresh_table(df.limit(2), str(tmp_path / "works"))
    assert spark.read.parquet(str(tmp_path / "works")).count() == 2
    tables.register_sql(spark, {"w": df})
    rows = spark.sql("SELECT client, PERCENT(count(*), 3) p, median(v) m FROM w GROUP BY client ORDER BY client").collect()
    assert [tuple(r) for r in rows] == [("A", 66.67, 2.5), ("B", 33.33, 10.0)]
    assert spark.sql("SELECT DAYS_BETWEEN('2021-03-10', '2016-11-22 10:00'), DAYS_BETWEEN(NULL, 'x')").first()[0:2] == (1569, 0)


def test_shared_folder_is_taken_from_the_session(spark, tmp_path):
    from folioscope import session

    class Named:
        """A session whose configuration names the folder."""

        class conf:
            get = staticmethod(lambda key, default=None: str(tmp_path) if key == "spark.checkpoint.dir" else default)

    assert session.shared_folder(Named) == str(tmp_path)
    kept = session.cut_lineage(spark.range(5))
    assert sorted(r[0] for r in kept.collect()) == [0, 1, 2, 3, 4]
    assert "Range" not in kept._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("value, kind, strict, loose", [
    (None, "money", "no value", "no value"), (1001.0, "count", "count too large", None), (101.0, "percent", "percent out of range", None),
    (-1.0, "days", "days out of range", "days out of range"), (2e12, "money", None, "money out of range"), (5.0, "count", None, None),
])
def test_plausibility(spark, value, kind, strict, loose):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(value, kind)], "v double, k string")
    assert tuple(df.select(scoring.implausible("v", "k"), scoring.implausible_loose("v", "k", F.lit(5000))).first()) == (strict, loose)


@pytest.mark.parametrize("open_cost, block", [("4194304", "134217728"), ("0", "64"), ("1", "200")])
def test_last_row_wins_over_files_however_they_are_packed(spark, tmp_path, open_cost, block):
    (tmp_path / "a.csv").write_text("".join(f"q{i},{i}\n" for i in range(40)))
    (tmp_path / "b.csv").write_text("\nnote,answer,qid\n" + "".join(f"x,{i + 0.5},q{i}\n" for i in range(0, 40, 2)) + "qid,7,q39\n")
    (tmp_path / "c.csv").write_text('question_id,answer\nq1,"INR 1,000"\nq1,900\nqid,3\n')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        got = {r["qid"]: r["answer"] for r in answers.read_answers(spark, str(tmp_path)).collect()}
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    want = {f"q{i}": float(i) for i in range(40)} | {f"q{i}": i + 0.5 for i in range(0, 40, 2)} | {"q39": 7.0, "q1": 900.0, "qid": 3.0}
    assert got == want


def test_answers_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n \n")
    assert answers.read_answers(spark, str(tmp_path)).count() == 0


def test_questions_keep_their_order_over_files_and_blocks(spark, tmp_path):
    for n, name in enumerate("abc"):
        lines = [json.dumps({"qid": f"{name}{i:03d}", "question": "?"}) for i in range(50)]
        lines.append(json.dumps({"questions": [{"qid": f"{name}9{i}", "question": "?"} for i in range(3)]}))
        (tmp_path / f"{name}.json").write_text("\n".join(lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        read = questions.read_questions(spark, str(tmp_path), lines=True)
        assert read.rdd.getNumPartitions() > 6
        got = [r["qid"] for r in read.orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [q for n in "abc" for q in [f"{n}{i:03d}" for i in range(50)] + [f"{n}9{i}" for i in range(3)]]


def test_ordered_sink_writes_many_parts_with_one_header(spark, tmp_path):
    rows = spark.range(2000).selectExpr("(id * 7919) % 2000 AS pos", "concat('q, ', (id * 7919) % 2000) AS question_id", "CAST(if(id % 5 = 0, NULL, id) AS DOUBLE) AS answer")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        answers.write_submission(rows, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    assert len(parts) > 1
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[0] == "question_id,answer" and sum(x == lines[0] for x in lines) == 1
    assert [x.split('"')[1] for x in lines[1:]] == [f"q, {i}" for i in range(2000)]
    read = {r["qid"]: r["answer"] for r in answers.read_answers(spark, str(tmp_path / "out")).collect()}
    assert len(read) == 2000 and read["q, 0"] is None and read[f"q, {7919 % 2000}"] == 1.0
    answers.write_submission(rows.limit(0), str(tmp_path / "none"))
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*.csv")) == "question_id,answer\n"


def test_a_published_table_changes_in_one_step(spark, tmp_path):
    path = str(tmp_path / "works")
    with pytest.raises(ValueError):
        tables.published_table(spark, path)
    first = spark.createDataFrame([("A", 1), ("B", None)], "k string, v int")
    assert tables.publish_table(first, path, unique=["k"]) == 2
    reader = tables.published_table(spark, path)
    assert tables.publish_table(first.filter("k = 'A'"), path, unique=["k"], required=["k", "v"]) == 1
    assert reader.count() == 2  # the version before stays for those who read it
    assert [tuple(r) for r in tables.published_table(spark, path).collect()] == [("A", 1)]
    for rows, message in ((first, "NULL in v"), (first.union(first), "NULL in v; repeated k")):
        with pytest.raises(tables.RejectedTable, match=message):
            tables.publish_table(rows, path, unique=["k"], required=["v"])
    assert [tuple(r) for r in tables.published_table(spark, path).collect()] == [("A", 1)]
    assert tables.publish_table(first.limit(0), path, unique=["k"]) == 0
    assert tables.published_table(spark, path).count() == 0
    assert len(list((tmp_path / "works").glob("v-*"))) == 2


def test_sheets_of_a_mixed_folder_are_routed_by_header(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "one.csv").write_text("\nInvoice No,Client,Outstanding (INR)\nI1,A,5\nInvoice No,B,6\n")
    (tmp_path / "x" / "two.csv").write_text('Client,Outstanding (INR),Invoice No,Invoice No,Note\nC,7,I2,again,"a, b"\nD,8\n')
    (tmp_path / "x" / "y" / "three.csv").write_text("Asset ID,Type\n1,Crane\n")
    (tmp_path / "x" / "four.csv").write_text("name,value\nn,1\n")
    (tmp_path / "x" / "five.csv").write_text("")
    sheets = files.read_sheets(spark, str(tmp_path))
    assert sorted(sheets) == ["plant_machinery_register", "receivables_ageing"]
    got = sorted(tuple(r) for r in sheets["receivables_ageing"].select("Client", "Invoice No", "Outstanding (INR)").fillna("-").collect())
    assert got == [("A", "I1", "5"), ("B", "Invoice No", "6"), ("C", "I2", "7"), ("D", "-", "8")]
    assert sorted(r["Note"] or "" for r in sheets["receivables_ageing"].collect()) == ["", "", "", "a, b"]
    assert [tuple(r) for r in sheets["plant_machinery_register"].collect()] == [("1", "Crane")]
    assert len({files.tabular_class(c) for c in (["Invoice No", "Outstanding"], ["asset ID"], ["x"])}) == 3
