"""Registered queries through files: tables rendered into the accepted layouts, written, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import dates, text as tx
from folioscope.operators import extract, scoring
from folioscope.plans import rendered as r, views as v
from folioscope.plans.text_queries import NAME_WORDS_SQL
from folioscope.session import cut_lineage, tables_of
from folioscope.sources import answers, files, questions, tables

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


@query(
    f"""WITH {r.client_questions_sql()}
        SELECT qid, question, CASE WHEN entity % 3 <> 1 THEN answer_type END AS answer_type,
               CASE WHEN entity % 3 = 1 THEN CAST(template AS DOUBLE) END AS answer,
               CAST(CASE WHEN entity % 3 = 2 THEN 0 ELSE template - 1 END AS INTEGER) AS place
        FROM client_questions"""
)
def question_file(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered questions as JSON Lines in the three layouts -> questions and their places in their lines."""
    asked = r.client_questions(spark, sf).withColumn("layout", F.col("entity") % 3)
    listed = F.array_sort(F.collect_list(F.struct("template", "qid", "question", "answer_type")))
    per_client = asked.groupBy("entity", "layout").agg(listed.alias("asked"))  # one entry a template
    first = F.struct(F.transform("asked", lambda x: F.struct(x.qid.alias("qid"), x.question.alias("question"), x.answer_type.alias("answer_type"))).alias("questions"))
    second = F.struct(F.transform("asked", lambda x: F.struct(
        x.qid.alias("question_id"), x.question.alias("question_text"), x.template.cast("double").alias("answer_gold"))).alias("answers"))
    nested = per_client.filter("layout < 2").select(F.when(F.col("layout") == 0, F.to_json(first)).otherwise(F.to_json(second)).alias("value"))
    single = asked.filter("layout = 2").select(F.to_json(F.struct("qid", "question", "answer_type")).alias("value"))
    with tables_of(spark).folder() as path:
        nested.union(single).write.text(path)
        read = questions.read_questions(spark, path, lines=True)
        return cut_lineage(read.select("qid", "question", "answer_type", "answer", F.col("pos._i").alias("place")))


@query(
    """SELECT concat('Q', o_orderkey) AS qid, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS answer FROM orders"""
)
def submission_file(spark: SparkSession, sf: str) -> DataFrame:
    """Answers written in question order, parts without a header among them, and read tolerantly."""
    key = F.col("o_orderkey")
    rows = v.table(spark, sf, "orders").select(
        key.alias("pos"), F.concat(F.lit("Q"), key.cast("string")).alias("question_id"),
        F.when(key % 4 != 0, F.col("o_totalprice").cast("double")).alias("answer"),
    )
    with tables_of(spark).folder() as path:
        answers.write_submission(rows, path)
        return cut_lineage(answers.read_answers(spark, path))


@query(
    """SELECT concat('Q', o_orderkey) AS question_id,
              CASE o_orderkey % 4 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 3.0 END * CAST(o_totalprice AS DOUBLE) AS answer,
              CASE o_orderkey % 4 WHEN 1 THEN '1.000' WHEN 2 THEN '0.500' ELSE '0.000' END AS score
       FROM orders"""
)
def scored_run_file(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that are right, half, three times too large or missing -> report file."""
    key, gold = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    asked = v.table(spark, sf, "orders").select(F.concat(F.lit("Q"), key.cast("string")).alias("qid"), key.alias("k"), gold.alias("gold"))
    factor = F.when(F.col("k") % 4 == 1, 1.0).when(F.col("k") % 4 == 2, 0.5).otherwise(3.0)
    given = asked.filter("k % 4 <> 0").select("qid", (factor * F.col("gold")).alias("answer"))
    report = scoring.question_report(asked.select("qid", F.lit("hop_aggregate").alias("shape"), "gold"), given)
    with tables_of(spark).folder() as path:
        answers.write_scored_run(report, path)
        written = spark.read.csv(path, "question_id string, answer string, score string")
        titled = F.col("question_id") == "question_id"
        return cut_lineage(written.filter(~titled).withColumn("answer", F.col("answer").cast("double")))


@query(
    """SELECT concat(conv_id, '-', turn) AS uid, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS answer,
              CASE WHEN turn % 3 = 2 THEN '' WHEN turn % 3 = 1 THEN 'million' ELSE '' END AS scale FROM conversations"""
)
def prediction_file(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as predicted answers, every third one failed, through the prediction file."""
    turn = F.col("turn")
    predicted = v.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("uid"), F.when(turn % 3 != 2, F.array("text")).alias("answer"),
        F.when(turn % 3 == 1, "million").alias("scale"),
    )
    with tables_of(spark).folder() as path:
        answers.write_predictions(predicted, path)
        back = spark.read.schema("uid string, answer array<string>, scale string").json(path)
        return cut_lineage(back.select("uid", F.element_at("answer", 1).alias("answer"), "scale"))


TABLE_QUESTIONS_SQL = """WITH d AS (
        SELECT l_orderkey, count(*) AS n_rows, min(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey)
    SELECT concat(l_orderkey, '-', i) AS uid, concat('total of ', l_orderkey, '?') AS question,
           CAST(n_rows AS INTEGER) AS n_rows, CAST(first_line AS VARCHAR) AS first_cell
    FROM d CROSS JOIN (VALUES (0), (1)) AS x(i)"""


def _table_documents(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as a document of one table and two questions, in order of the keys."""
    line = F.struct("l_linenumber", F.col("l_quantity").cast("string").alias("q"))
    orders = v.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    key = F.col("l_orderkey").cast("string")
    asked = F.transform(F.array(F.lit("0"), F.lit("1")), lambda i: F.struct(
        F.concat_ws("-", key, i).alias("uid"), F.concat(F.lit("total of "), key, F.lit("?")).alias("question")))
    cells = F.transform("lines", lambda x: F.array(x.l_linenumber.cast("string"), x.q))
    doc = F.struct(F.struct(cells.alias("table")).alias("table"), asked.alias("questions"))
    return orders.select("l_orderkey", F.to_json(doc).alias("value")).orderBy("l_orderkey").select("value")


def _asked_of_tables(spark: SparkSession, sf: str, limit: int | None) -> DataFrame:
    with tables_of(spark).folder() as path:
        _table_documents(spark, sf).write.text(path)
        read = questions.read_table_documents(spark, path, limit, lines=True)
        return cut_lineage(read.select(
            "uid", "question", F.size("table").alias("n_rows"), F.col("table")[0][0].alias("first_cell")
        ))


@query(TABLE_QUESTIONS_SQL)
def table_question_file(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of all table documents."""
    return _asked_of_tables(spark, sf, None)


@query(TABLE_QUESTIONS_SQL + " ORDER BY l_orderkey, i LIMIT 100")
def first_table_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred questions in file order."""
    return _asked_of_tables(spark, sf, 100)


@query(
    """SELECT 'receivables_ageing' AS cls, concat('INV-', l_orderkey, '-', l_linenumber) AS id, concat('Client ', l_suppkey) AS name,
              CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, CAST(l_shipdate AS DATE) AS dated
       FROM lineitem WHERE l_returnflag <> 'A'
       UNION ALL
       SELECT 'plant_machinery_register', CAST(p_partkey AS VARCHAR), p_type, CAST(round_even(p_retailprice, 0) AS BIGINT), NULL
       FROM part WHERE p_partkey % 5 <> 4"""
)
def sheet_routing(spark: SparkSession, sf: str) -> DataFrame:
    """One folder of ageing sheets in two layouts, a plant register and other sheets -> two typed tables."""
    ageing, plant = r.receivables_sheet(spark, sf), r.asset_sheet(spark, sf)
    odd = F.crc32("Invoice No") % 2 == 1
    turned = ageing.filter(odd).select(*reversed(ageing.columns)).withColumn("Remarks", F.lit('"seen", twice'))
    with tables_of(spark).folder() as path:
        sheets = {"ageing/a": ageing.filter(~odd), "ageing/b/late": turned, "plant": plant, "other": v.table(spark, sf, "nation")}
        for name, sheet in sheets.items():
            sheet.write.csv(f"{path}/{name}", header=True)
        read = files.read_sheets(spark, path)
        bills = extract.conform_receivables_sheet(read["receivables_ageing"]).select(
            F.lit("receivables_ageing").alias("cls"), F.col("invoice_no").alias("id"), F.col("client_name").alias("name"),
            F.col("invoiced_inr").alias("amount"), F.col("invoice_date").alias("dated"),
        )
        assets = extract.conform_asset_sheet(read["plant_machinery_register"]).select(
            F.lit("plant_machinery_register").alias("cls"), F.col("asset_id").cast("string").alias("id"),
            F.col("asset_type").alias("name"), F.col("cost_inr").alias("amount"), F.lit(None).cast("date").alias("dated"),
        )
        return cut_lineage(bills.unionByName(assets))


@query(
    """SELECT o_orderkey AS work_id, o_custkey AS client_name, CAST(round(o_totalprice * 100) AS BIGINT) AS value_inr,
              true AS kept_when_rejected FROM orders"""
)
def published_works(spark: SparkSession, sf: str) -> DataFrame:
    """Works published, replaced in one step, then a version with repeated ids that is rejected."""
    works = v.works(spark, sf).select("work_id", "client_name", "value_inr")
    with tables_of(spark).folder() as path:
        tables.publish_table(works.withColumn("value_inr", F.lit(0).cast("bigint")), path)
        tables.publish_table(works, path, unique=["work_id"], required=["work_id", "value_inr"])
        try:
            tables.publish_table(works.unionAll(works), path, unique=["work_id"])
            rejected = False
        except tables.RejectedTable:
            rejected = True
        return cut_lineage(tables.published_table(spark, path).withColumn("kept_when_rejected", F.lit(rejected)))


TITLE_SQL = r.title_sql("o_orderkey")


@query(
    f"""SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS first_date, concat('DOC-', o_orderkey, '.v1') AS doc_id,
               array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower({TITLE_SQL}), '[–-]', ' ', 'g')), '\\s+'),
                   lambda w: length(w) > 2 AND w NOT IN ('package', 'pkg')), ' ') AS title_words,
               array_to_string(list_filter({NAME_WORDS_SQL.format(c=TITLE_SQL)},
                   lambda w: NOT list_contains({NAME_WORDS_SQL.format(c=v.category_name_sql())}, w)), ' ') AS unmasked
        FROM orders"""
)
def title_parts(spark: SparkSession, sf: str) -> DataFrame:
    """First written date of a question, id of a path, title words, and words left by a category's mask."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    written = F.when(key % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 3 == 1, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "d MMM yyyy"))
    asked = F.concat(F.lit("What came in from "), written, F.lit(" on, before 2001-01-31 or after 3 May 2002?"))
    path = F.concat(F.lit("/data/"), (key % 7).cast("string"), F.lit("/DOC-"), key.cast("string"), F.lit(".v1.pdf"))
    title = r.title("o_orderkey")
    rows = v.table(spark, sf, "orders").select(
        key.alias("id"), dates.written_date(asked).alias("written"), tx.doc_id_from_path(path).alias("doc_id"),
        F.array_join(tx.title_words(title), " ").alias("title_words"),
        F.array_join(F.array_sort(tx.without_words(tx.name_words(title), tx.name_words(v.category_name()))), " ").alias("unmasked"),
    )
    return rows.select("id", dates.parse_date("written").alias("first_date"), "doc_id", "title_words", "unmasked")
