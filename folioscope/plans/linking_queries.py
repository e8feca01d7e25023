"""Registered queries for name resolution, linking, batch answering and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import fixed_values as fv, text as tx
from folioscope.operators import answers, classify, linking, merge, resolve as rs, scoring
from folioscope.operators.containment import contained_names
from folioscope.plans import rendered as r, views as v
from folioscope.plans.text_queries import ACRONYMS_SQL, FUNCTION_WORDS_SQL, NAME_WORDS_SQL
from folioscope.session import cut_lineage
from folioscope.sources.answers import tolerant_answers
from folioscope.sources.files import classify_documents

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog whose names are whole benchmark passages."""
    return v.table(spark, sf, "benchmark").select(F.trim("text").alias("name"))


def _pooled(df: DataFrame) -> DataFrame:
    return df.withColumn(rs.POOL, F.lit(""))


def _result(df: DataFrame) -> DataFrame:
    """Resolve result with plain columns: tied names as one text, confidence rounded."""
    return df.select(
        F.col("qid").alias("doc_id"), "matched", F.round("confidence", 6).alias("confidence"),
        F.array_join("tied", " || ").alias("tied"), "method",
    )


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def exact_link(spark: SparkSession, sf: str) -> DataFrame:
    """Documents containing a whole benchmark passage, over whole texts."""
    items = v.table(spark, sf, "benchmark")
    hits = contained_names(_documents(spark, sf), items, "qid", "question", "text")
    return hits.join(items, "text").select(F.col("qid").alias("doc_id"), "item_id")


WORD_ROWS = f"""
    q AS (SELECT doc_id AS qid, unnest({NAME_WORDS_SQL.format(c='text')}) AS word FROM documents),
    c AS (SELECT name, unnest({NAME_WORDS_SQL.format(c='name')}) AS word FROM (SELECT DISTINCT trim(text) AS name FROM benchmark)),
    f AS (SELECT word, count(*) AS df FROM c GROUP BY word),
    w AS (SELECT c.name, c.word, f.df FROM c JOIN f ON f.word = c.word),
    t AS (SELECT name, sum(1.0::DOUBLE / df) AS total FROM w GROUP BY name),
    s AS (SELECT qid, w.name, sum(1.0::DOUBLE / df) AS overlap, count(*) AS n, min(df) AS min_df
          FROM q JOIN w ON w.word = q.word GROUP BY qid, w.name),
    scores AS (SELECT qid, s.name, overlap, overlap / total AS frac FROM s JOIN t ON t.name = s.name
               WHERE n >= 2 OR min_df = 1),"""

# Leader, runner-up and ties of (qid, name, overlap, frac) rows.
DECIDE = """
    ranked{x} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, frac DESC, name DESC) AS rn FROM {scores}),
    top{x} AS (SELECT qid, name AS t_name, overlap AS t_ov, frac AS t_fr FROM ranked{x} WHERE rn = 1 AND frac >= {min_score}),
    run{x} AS (SELECT qid, frac AS r_fr FROM ranked{x} WHERE rn = 2),
    joined{x} AS (SELECT s.qid, any_value(t_name) AS t_name, any_value(t_fr) AS t_fr,
                      count(*) FILTER (WHERE abs(overlap - t_ov) < 1e-9) AS n_same,
                      any_value(t_fr) - coalesce(any_value(r_fr), 0) AS margin,
                      string_agg(name, ' || ' ORDER BY name) FILTER (WHERE abs(overlap - t_ov) < 1e-9) AS same_names,
                      string_agg(name, ' || ' ORDER BY name) FILTER (WHERE t_fr - frac < {min_margin}) AS near_names
               FROM {scores} s JOIN top{x} t ON t.qid = s.qid LEFT JOIN run{x} u ON u.qid = s.qid GROUP BY s.qid),
    decided{x} AS (SELECT qid, CASE WHEN n_same < 2 AND margin >= {min_margin} THEN t_name END AS matched, t_fr AS confidence,
                       CASE WHEN n_same >= 2 THEN same_names WHEN margin < {min_margin} THEN near_names ELSE '' END AS tied
                FROM joined{x})"""


@query(
    "WITH " + WORD_ROWS + DECIDE.format(x="", scores="scores", min_score=0.3, min_margin=0.15)
    + "\n SELECT qid AS doc_id, matched, round(confidence, 6) AS confidence, tied, 'fuzzy' AS method FROM decided"
)
def fuzzy_link(spark: SparkSession, sf: str) -> DataFrame:
    """The fuzzy tier alone: documents against passages by rarity-weighted words."""
    asked = _pooled(_documents(spark, sf)).withColumn("words", tx.name_words("question"))
    names = cut_lineage(_pooled(_passages(spark, sf).distinct()))
    decided = rs.fuzzy(rs.question_words(asked, names), names, rs.MIN_SCORE, rs.MIN_MARGIN)
    return _result(decided.withColumn("method", F.lit("fuzzy")))


NAMED_TOKENS_SQL = (
    "list_distinct(list_transform(list_filter(regexp_split_to_array({c}, '[^\\pL\\pN_]+'), "
    "lambda x: regexp_full_match(x, '[A-Za-z]{{2,6}}') AND NOT list_contains(" + FUNCTION_WORDS_SQL + ", upper(x))), lambda x: upper(x)))"
)


ORG_SQL = "concat(p_type, ' ', p_name, ', ', p_brand)"


ACRONYM_CLASSES_SQL = f"""WITH orgs AS (SELECT DISTINCT {ORG_SQL} AS name FROM part),
        m AS (SELECT name, array_to_string({ACRONYMS_SQL.format(c='name')}, ' ') AS class FROM orgs)"""


def _orgs(spark: SparkSession, sf: str) -> DataFrame:
    org = F.concat("p_type", F.lit(" "), "p_name", F.lit(", "), "p_brand")
    return _pooled(v.table(spark, sf, "part").select(org.alias("name")).distinct())


@query(
    f"""{ACRONYM_CLASSES_SQL},
        l AS (SELECT name, unnest(string_split(class, ' ')) AS acronym FROM m WHERE class <> ''),
        q AS (SELECT doc_id, unnest({NAMED_TOKENS_SQL.format(c='text')}) AS acronym FROM documents)
        SELECT doc_id, q.acronym, name FROM q JOIN l ON l.acronym = q.acronym"""
)
def acronym_link(spark: SparkSession, sf: str) -> DataFrame:
    """Acronym tier alone: every short word of a document with every catalog name whose initials it spells."""
    members = cut_lineage(rs.acronym_classes(_orgs(spark, sf)))
    hits = rs.acronym_class_hits(_pooled(_documents(spark, sf)), members)
    return hits.join(members, [rs.POOL, "class"]).select(F.col("qid").alias("doc_id"), "acronym", "name")


@query(ACRONYM_CLASSES_SQL + " SELECT class, name FROM m WHERE class <> ''")
def acronym_members(spark: SparkSession, sf: str) -> DataFrame:
    """The names of each class of equal acronyms."""
    return rs.acronym_classes(_orgs(spark, sf)).select("class", "name")


CASCADE_SQL = (
    "WITH names AS (SELECT DISTINCT trim(text) AS name FROM benchmark),"
    + WORD_ROWS
    + DECIDE.format(x="", scores="scores", min_score=0.3, min_margin=0.15)
    + f""",
    e AS (SELECT doc_id AS qid, name FROM documents JOIN names ON contains(lower(text), lower(name))),
    aq AS (SELECT doc_id AS qid, unnest({NAMED_TOKENS_SQL.format(c='text')}) AS acronym FROM documents
           WHERE doc_id NOT IN (SELECT qid FROM e)),
    ac AS (SELECT DISTINCT name, unnest({ACRONYMS_SQL.format(c='name')}) AS acronym FROM names),
    a AS (SELECT DISTINCT qid, name FROM aq JOIN ac ON ac.acronym = aq.acronym),
    h AS (SELECT *, 'exact' AS method, 1.0 AS conf FROM e UNION ALL SELECT *, 'acronym', 0.95 FROM a),
    hn AS (SELECT qid, method, any_value(conf) AS conf, count(*) AS n, min(name) AS one,
                  string_agg(name, ' || ' ORDER BY name) AS names FROM h GROUP BY qid, method),
    nw AS (SELECT h.qid, h.name, c.word FROM h JOIN hn ON hn.qid = h.qid AND hn.n > 1 JOIN c ON c.name = h.name),
    nf AS (SELECT qid, word, count(*) AS df FROM nw GROUP BY qid, word),
    nj AS (SELECT nw.qid, nw.name, df, q.word IS NOT NULL AS hit FROM nw
           JOIN nf ON nf.qid = nw.qid AND nf.word = nw.word LEFT JOIN q ON q.qid = nw.qid AND q.word = nw.word),
    nscores AS (SELECT qid, name, coalesce(sum(1.0::DOUBLE / df) FILTER (WHERE hit), 0) AS overlap,
                       coalesce(sum(1.0::DOUBLE / df) FILTER (WHERE hit), 0) / sum(1.0::DOUBLE / df) AS frac
                FROM nj GROUP BY qid, name
                HAVING count(*) FILTER (WHERE hit) >= 2 OR (count(*) FILTER (WHERE hit) = 1 AND min(df) FILTER (WHERE hit) = 1)),"""
    + DECIDE.format(x="2", scores="nscores", min_score=0.15, min_margin=0.1)
    + """,
    early AS (SELECT hn.qid, CASE WHEN n = 1 THEN one ELSE d.matched END AS matched,
                     CASE WHEN d.matched IS NOT NULL THEN d.confidence ELSE conf END AS confidence,
                     CASE WHEN n = 1 OR d.matched IS NOT NULL THEN '' ELSE names END AS tied,
                     CASE WHEN d.matched IS NOT NULL THEN 'fuzzy' ELSE method END AS method
              FROM hn LEFT JOIN (SELECT * FROM decided2 WHERE matched IS NOT NULL) d ON d.qid = hn.qid AND n > 1)
    SELECT d.doc_id, coalesce(x.matched, y.matched) AS matched,
           round(CAST(coalesce(x.confidence, y.confidence, 0) AS DOUBLE), 6) AS confidence,
           coalesce(x.tied, y.tied, '') AS tied,
           CASE WHEN x.qid IS NOT NULL THEN x.method WHEN y.qid IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method
    FROM documents d LEFT JOIN early x ON x.qid = d.doc_id
    LEFT JOIN decided y ON y.qid = d.doc_id AND x.qid IS NULL"""
)


@query(CASCADE_SQL)
def resolve_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cascade with tie narrowing and abstention for every document."""
    return _result(rs.resolve(_documents(spark, sf), _passages(spark, sf), "name"))


@query(
    f"""WITH {r.client_questions_sql()},
        named AS (SELECT qid, entity FROM client_questions)
        SELECT qid, c_name AS matched, 'exact' AS method FROM named JOIN customer ON c_custkey = entity"""
)
def client_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Client names in rendered questions against the live client catalog."""
    asked = r.client_questions(spark, sf)
    names = merge.catalog(v.table(spark, sf, "customer"), "c_name", "c_custkey")
    return rs.resolve(asked, names, "c_name").select("qid", "matched", "method")


CATEGORY_WORDS = {"roads highways": 2, "bridges flyovers": 2, "water supply": 2, "tunnels": 1, "irrigation": 1}


@query(
    f"""WITH cats AS (SELECT DISTINCT {v.category_name_sql()} AS category FROM orders),
        q AS (SELECT o_orderkey AS qid, {v.category_name_sql()} AS category,
                     concat('works of type ', {v.category_name_sql()}, ' near the water supply') AS question FROM orders),
        qw AS (SELECT qid, unnest({NAME_WORDS_SQL.format(c='question')}) AS word, length({NAME_WORDS_SQL.format(c='question')}) AS n_q FROM q),
        cw AS (SELECT category, unnest({NAME_WORDS_SQL.format(c='category')}) AS word, length({NAME_WORDS_SQL.format(c='category')}) AS n_c FROM cats),
        hits AS (SELECT qid, category, count(*) AS overlap, count(*)::DOUBLE / least(any_value(n_q), any_value(n_c)) AS frac
                 FROM qw JOIN cw ON cw.word = qw.word GROUP BY qid, category)
        SELECT qid, category, overlap, round(frac, 6) AS frac, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, frac DESC, category) AS rank
            FROM hits WHERE frac >= 0.4) WHERE rank <= 2"""
)
def category_link(spark: SparkSession, sf: str) -> DataFrame:
    works = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), v.category_name().alias("category"))
    asked = works.select(
        "qid", F.concat(F.lit("works of type "), "category", F.lit(" near the water supply")).alias("question")
    )
    ranked = rs.rank_categories(asked, works.select("category").distinct(), top_n=2)
    return ranked.select("qid", "category", "overlap", F.round("frac", 6).alias("frac"), "rank")


def _spans_sql(column: str) -> str:
    by_length = sorted(fv.CATEGORY_SYNONYMS, key=len, reverse=True)
    text = f"lower({column})"
    for i, synonym in enumerate(by_length):
        text = f"regexp_replace({text}, '\\b{synonym}\\b', concat(chr(1), '{i}', chr(2)), 'g')"
    names = "[" + ", ".join(f"'{s}'" for s in by_length) + "]"
    return (
        f"list_transform(regexp_extract_all({text}, concat(chr(1), '([0-9]+)', chr(2)), 1), "
        f"lambda m: {names}[CAST(m AS INTEGER) + 1])"
    )


SPAN_TEXT_SQL = (
    f"concat('large bridges and flyovers or ', {v.category_name_sql()}, ', then roads maintenance ', o_orderkey, "
    "'; drainage and sewerage drainage, broads, industrial epc/epc')"
)


@query(f"SELECT o_orderkey AS id, array_to_string({_spans_sql(SPAN_TEXT_SQL)}, '; ') AS spans FROM orders")
def category_spans(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.lit("large bridges and flyovers or "), v.category_name(), F.lit(", then roads maintenance "),
        F.col("o_orderkey").cast("string"), F.lit("; drainage and sewerage drainage, broads, industrial epc/epc"),
    )
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.array_join(linking.category_spans(text), "; ").alias("spans")
    )


@query(
    """SELECT lower(regexp_extract(trim(text), '(\\S+)', 1)) AS first, min(text) AS name FROM benchmark
       GROUP BY 1 HAVING count(*) = 1"""
)
def unique_first_token(spark: SparkSession, sf: str) -> DataFrame:
    people = v.table(spark, sf, "benchmark").select(F.col("text").alias("name"), F.col("item_id").alias("emp_id"))
    return linking.unique_first_names(people)


# --- linking and batch answering over rendered questions ----------------------------------------------------

def _linked(spark: SparkSession, sf: str, works: DataFrame, certs: DataFrame) -> DataFrame:
    asked = cut_lineage(r.client_questions(spark, sf).unionByName(r.engineer_questions(spark, sf)))
    engineers = r.engineers(spark, sf)
    clients = v.table(spark, sf, "customer").select(F.col("c_name").alias("client_name"))
    return linking.link_questions(asked, works, engineers, certs, clients)


ENGINEER_SQL = v.person_name_sql("s_suppkey")
FIRST_WORK_SQL = "SELECT lead_id, min(work_id) AS first_work FROM leads GROUP BY lead_id"
FIRST_CERT_SQL = f"""SELECT person, arg_min(CAST(issue_date - INTERVAL {v.CREDENTIAL_SHIFT_DAYS} DAY AS DATE), event_id) AS issued,
                            min(event_id) AS event_id FROM certs GROUP BY person"""


def _template_rows(questions: list) -> str:
    return "(VALUES " + ", ".join(f"({t}, '{k}', '{s}')" for t, k, s, _ in questions) + ") AS x(t, k, shape)"


@query(
    v.with_views(
        f"""SELECT concat('e-', s_suppkey, '-', t) AS qid, {ENGINEER_SQL} AS engineer,
                   CASE WHEN t = 23 THEN concat('Pkg-', first_work) WHEN n_led = 1 THEN concat('Pkg-', first_work) END AS package_no,
                   CASE WHEN t = 23 OR n_led = 1 THEN client_name END AS client_name,
                   CASE WHEN t <> 21 THEN 'PMP' END AS cred_type,
                   CASE WHEN t <> 21 THEN lpad(CAST(event_id AS VARCHAR), 12, '0') END AS cert_doc_id
            FROM supplier CROSS JOIN {_template_rows(r.ENGINEER_QUESTIONS)}
            JOIN ({FIRST_WORK_SQL}) fw ON fw.lead_id = s_suppkey
            JOIN (SELECT lead_id, count(*) AS n_led FROM leads GROUP BY lead_id) n ON n.lead_id = s_suppkey
            JOIN (SELECT o_orderkey, c_name AS client_name FROM orders JOIN customer ON c_custkey = o_custkey) o ON o.o_orderkey = first_work
            LEFT JOIN ({FIRST_CERT_SQL}) c ON c.person = s_suppkey
            UNION ALL
            SELECT concat('c-', c_custkey, '-', t), NULL, NULL, c_name, NULL, NULL
            FROM customer CROSS JOIN {_template_rows(r.CLIENT_QUESTIONS)}""",
        "leads", "certs",
    )
)
def priority_link(spark: SparkSession, sf: str) -> DataFrame:
    """Engineer, package, client and credential linked for every rendered question."""
    works, certs = cut_lineage(r.named_works(spark, sf)), cut_lineage(r.named_certs(spark, sf))
    return _linked(spark, sf, works, certs).select("qid", "engineer", "package_no", "client_name", "cred_type", "cert_doc_id")


def _answers_sql() -> str:
    cat = v.category_name_sql("category")
    year = f"year(completion_date + INTERVAL {v.WORK_SHIFT_YEARS} YEAR)"
    done = f"CAST(completion_date + INTERVAL {v.WORK_SHIFT_YEARS} YEAR AS DATE)"
    per_client = f"""SELECT client_name AS ck, awarded AS t4, CAST(n_works - n_referenced AS DOUBLE) AS t1,
               round_even(CAST(100.0 * n_referenced / n_works AS DOUBLE), 2) AS t2, round_even(mean_value, 0) AS t5,
               abs(round_even(mean_value - median_value, 0)) AS t6 FROM work_stats"""
    conditional = f"""SELECT client_name AS ck,
               sum(value_inr) FILTER (WHERE value_inr >= 20000000) AS t8,
               CASE WHEN count(*) FILTER (WHERE {cat} = 'tunnels') > 0
                    THEN coalesce(sum(value_inr) FILTER (WHERE {cat} <> 'tunnels'), 0) ELSE sum(value_inr) END AS t10,
               abs(coalesce(sum(value_inr) FILTER (WHERE {cat} = 'irrigation'), 0)
                   - coalesce(sum(value_inr) FILTER (WHERE {cat} = 'water supply'), 0)) AS t13,
               abs(coalesce(sum(value_inr) FILTER (WHERE {year} = 2011), 0)
                   - coalesce(sum(value_inr) FILTER (WHERE {year} = 2012), 0)) AS t14,
               max(value_inr) FILTER (WHERE rn = 1) - coalesce(max(value_inr) FILTER (WHERE rn = 2), 0) AS t7
        FROM (SELECT *, row_number() OVER (PARTITION BY client_name ORDER BY value_inr DESC, work_id) AS rn FROM works)
        GROUP BY client_name"""
    engineer = f"""SELECT l.lead_id AS ek, count(DISTINCT category) AS t21,
               CASE WHEN any_value(issued) IS NOT NULL THEN coalesce(sum(value_inr) FILTER (WHERE {done} > issued), 0) END AS t22,
               any_value(abs(date_diff('day', issued, fw_done))) AS t23
        FROM leads l JOIN works w ON w.work_id = l.work_id
        JOIN ({FIRST_WORK_SQL}) fw ON fw.lead_id = l.lead_id
        JOIN (SELECT work_id AS fw_id, {done} AS fw_done FROM works) d ON d.fw_id = fw.first_work
        LEFT JOIN ({FIRST_CERT_SQL}) c ON c.person = l.lead_id GROUP BY l.lead_id"""
    case_client = """CASE t WHEN 1 THEN coalesce(t1, 0) WHEN 2 THEN t2
        WHEN 3 THEN CASE WHEN invoiced > 0 THEN round_even(CAST(100.0 * received / invoiced AS DOUBLE), 2) ELSE 0 END
        WHEN 4 THEN t4 WHEN 5 THEN t5 WHEN 6 THEN t6 WHEN 7 THEN t7 WHEN 8 THEN coalesce(t8, 0)
        WHEN 9 THEN 200000000 - coalesce(t4, 0) WHEN 10 THEN t10
        WHEN 11 THEN abs(coalesce(t4, 0) - coalesce(invoiced, 0)) WHEN 12 THEN coalesce(outstanding, 0)
        WHEN 13 THEN CASE WHEN quirk THEN t4 ELSE coalesce(t13, 0) END WHEN 14 THEN coalesce(t14, 0) END"""
    # Digits of a client's name can look like a decade, which rules the category shape out.
    body = f""", q AS (SELECT *, c_name LIKE '%201%' OR c_name LIKE '%202%' AS quirk FROM customer
                       CROSS JOIN {_template_rows(r.CLIENT_QUESTIONS)}),
        pc AS ({per_client}), cc AS ({conditional}), en AS ({engineer})
        SELECT concat('c-', c_custkey, '-', t) AS qid,
               CASE WHEN t = 13 AND quirk THEN 'hop_aggregate' ELSE shape END AS shape,
               CAST(CASE WHEN known THEN coalesce({case_client}, 0) WHEN t = 9 THEN 200000000 ELSE 0 END AS DOUBLE) AS answer
        FROM (SELECT q.*, pc.*, cc.*, b.*, pc.ck IS NOT NULL OR b.client_name IS NOT NULL AS known
              FROM q LEFT JOIN pc ON pc.ck = c_custkey LEFT JOIN cc ON cc.ck = c_custkey
              LEFT JOIN bill_stats b ON b.client_name = c_custkey)
        UNION ALL
        SELECT concat('e-', s_suppkey, '-', t), shape, CAST(CASE t WHEN 21 THEN t21 WHEN 22 THEN t22 ELSE t23 END AS DOUBLE)
        FROM supplier CROSS JOIN {_template_rows(r.ENGINEER_QUESTIONS)} JOIN en ON en.ek = s_suppkey"""
    return v.with_views("", "work_stats", "bill_stats", "leads", "certs").rstrip() + body


@query(_answers_sql())
def batch_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Link, classify and answer every rendered question of all 17 shapes at once."""
    works, certs = cut_lineage(r.named_works(spark, sf)), cut_lineage(r.named_certs(spark, sf))
    answered = answers.answer_questions(
        _linked(spark, sf, works, certs), works, r.named_receivables(spark, sf), certs
    )
    return answered.select("qid", "shape", F.col("answer").cast("double").alias("answer"))


# --- scope decision --------------------------------------------------------------------------------------------


@query(
    f"""SELECT concat('s-', o_orderkey) AS qid, c_name AS client, {r.title_sql('o_orderkey')} AS project,
               CASE WHEN o_orderkey % 3 < 2 THEN c_name END AS scope,
               CASE WHEN o_orderkey % 3 < 2 THEN 'client' END AS scope_kind
        FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def scope_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that name a package as context: its client overrides the wording and is the scope."""
    works = cut_lineage(r.named_works(spark, sf))
    key = F.regexp_extract("package_no", r"(\d+)", 1).cast("bigint")
    wording = (
        F.when(key % 3 == 0, F.lit("what is the combined value of every completed work for that client?"))
        .when(key % 3 == 1, F.lit("what is the mean against the median for that client?"))
        .otherwise(F.lit("what is its own value?"))
    )
    asked = works.select(
        F.concat(F.lit("s-"), key.cast("string")).alias("qid"),
        F.concat(F.lit("Starting from "), "package_no", F.lit(", "), wording).alias("question"),
        F.lit(None).cast("string").alias("scope_engineer"),
        F.lit(None).cast("string").alias("scope_client"),
    )
    categories = works.select("category").distinct()
    projects = rs.resolve_project(asked, works, categories).select(
        "qid", F.col("matched").alias("project"), F.col("method").alias("project_method")
    )
    resolved = asked.join(projects, "qid", "left").withColumns(
        {
            "client": F.lit(None).cast("string"),
            "client_tied": F.array().cast("array<string>"),
            "engineer": F.lit(None).cast("string"),
            "cred_type": F.lit(None).cast("string"),
        }
    )
    settled = rs.override_client(resolved, works)
    decided = classify.scope_decision(classify.flag_questions(settled))
    return decided.select("qid", "client", "project", "scope", "scope_kind")


# --- scoring -----------------------------------------------------------------------------------------------------


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals as gold, a perturbed copy as the submission, some unanswered or unscored."""
    orders = v.table(spark, sf, "orders")
    value = v.cents(F.col("o_totalprice"))
    gold = orders.select(
        F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("shape"),
        F.when(F.col("o_orderkey") % 10 == 9, F.lit(0)).otherwise(value).alias("gold"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(False)).alias("scored"),
    )
    shift = (F.col("o_orderkey") % 5) * 10000000
    submitted = orders.filter("o_orderkey % 11 <> 0").select(
        F.col("o_orderkey").alias("qid"),
        F.when(F.col("o_orderkey") % 20 == 9, F.lit(0)).otherwise(value + shift).alias("answer"),
    )
    return scoring.question_report(gold, submitted)


REPORT_SQL = """WITH g AS (
        SELECT o_orderkey AS qid, o_orderpriority AS shape,
               CASE WHEN o_orderkey % 10 = 9 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS gold,
               CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 20 = 9 THEN 0
                    ELSE CAST(round(o_totalprice * 100) AS BIGINT) + o_orderkey % 5 * 10000000 END END AS answered
        FROM orders WHERE o_orderkey % 7 <> 0),
    report AS (SELECT *, CASE WHEN answered IS NULL THEN 0.0 WHEN gold = 0 THEN CASE WHEN answered = 0 THEN 1.0 ELSE 0.0 END
                    ELSE greatest(0.0, 1 - abs(answered - gold)::DOUBLE / abs(gold)) END::DOUBLE AS score FROM g)"""


@query(
    REPORT_SQL + """ SELECT qid, shape, gold, answered, round(score, 6) AS score,
        CASE WHEN score > 0.98 THEN 'OK' WHEN score > 0.5 THEN 'CLOSE' ELSE 'WRONG' END AS band FROM report"""
)
def score_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).withColumn("score", F.round("score", 6))


@query(
    REPORT_SQL + " SELECT shape, round(sum(score), 3) AS total, count(*) AS n, round(avg(score), 6) AS mean FROM report GROUP BY shape"
)
def score_by_shape(spark: SparkSession, sf: str) -> DataFrame:
    per_shape = scoring.score_by_shape(_report(spark, sf))
    return per_shape.select("shape", F.round("total", 3).alias("total"), "n", F.round("mean", 6).alias("mean"))


@query(
    REPORT_SQL + """ SELECT count(answered) AS answered, count(*) AS n, round(sum(score), 3) AS total, round(avg(score), 6) AS mean,
        count(*) FILTER (WHERE abs(answered - gold) < 1e-6) AS exact FROM report"""
)
def score_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = scoring.score_totals(_report(spark, sf))
    return totals.select("answered", "n", F.round("total", 3).alias("total"), F.round("mean", 6).alias("mean"), "exact")


KINDS_SQL = "['money', 'count', 'percent', 'days'][CAST(o_orderkey % 4 + 1 AS INTEGER)]"


@query(
    f"""WITH a AS (SELECT o_orderkey AS id, {KINDS_SQL} AS kind,
                   CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 1000 - 50 END AS val,
                   (SELECT count(*) FROM orders) AS biggest FROM orders)
        SELECT id, CASE WHEN val IS NULL THEN 'no value' WHEN kind = 'count' AND val > 1000 THEN 'count too large'
                        WHEN kind = 'percent' AND (val < 0 OR val > 100) THEN 'percent out of range'
                        WHEN kind = 'days' AND (val < 0 OR val > 36500) THEN 'days out of range' END AS reason,
               CASE WHEN val IS NULL THEN 'no value' WHEN kind = 'count' AND val > biggest THEN 'count too large'
                    WHEN kind = 'percent' AND abs(val) > 100000 THEN 'percent out of range'
                    WHEN kind = 'days' AND (val < 0 OR val > 36500) THEN 'days out of range'
                    WHEN kind = 'money' AND abs(val) > 1e12 THEN 'money out of range' END AS loose_reason FROM a"""
)
def plausibility(spark: SparkSession, sf: str) -> DataFrame:
    orders = v.table(spark, sf, "orders")
    kinds = F.array(*[F.lit(k) for k in ("money", "count", "percent", "days")])
    key = F.col("o_orderkey")
    rows = orders.select(
        key.alias("id"),
        F.element_at(kinds, (key % 4 + 1).cast("int")).alias("kind"),
        F.when(key % 13 != 0, F.col("o_totalprice") / 1000 - 50).alias("val"),
    )
    largest_table = orders.agg(F.count("*")).scalar()
    return rows.select(
        "id",
        scoring.implausible("val", "kind").alias("reason"),
        scoring.implausible_loose("val", "kind", largest_table).alias("loose_reason"),
    )


# --- sources and sinks over derived rows -----------------------------------------------------------------------------


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS qid, arg_max(CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END,
              o_orderkey) FILTER (WHERE true) AS answer FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
       WHERE rn = 1 GROUP BY o_custkey"""
)
def tolerant_answer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Answer cells with currency marks and commas; unreadable ones are NULL, the last row wins."""
    amount = F.format_number("o_totalprice", 2)
    cell = (
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a"))
        .when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("INR "), amount))
        .otherwise(F.concat(F.lit(" ₹ "), amount))
    )
    rows = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pos"), F.array(F.lit("x"), F.concat(F.col("o_custkey").cast("string"), F.lit(" ")), cell).alias("cells")
    )
    return tolerant_answers(rows, ["extra", " QID ", "Answer"])


@query(
    """SELECT source, CASE WHEN doc_id % 3 < 2 THEN 'completion_certificate_any' ELSE 'tender_notice' END AS cls,
              count(*) AS n_docs FROM documents GROUP BY 1, 2"""
)
def index_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Index entries decide the class; the two completion types are one."""
    docs = v.table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("page1"))
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit("completion_certificate ")).when(
        F.col("doc_id") % 3 == 1, F.lit("company_completion_certificate")
    ).otherwise(F.lit("tender_notice"))
    index = docs.select("doc_id", classify.index_class(kind).alias("cls"))
    classes = classify_documents(docs, index)
    return docs.select("doc_id", "source").join(classes, "doc_id").groupBy("source", "cls").agg(F.count("*").alias("n_docs"))


@query(
    """SELECT o_orderkey AS pos, concat('Q', o_orderkey) AS question_id,
              CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE round(o_totalprice, 2) END AS DOUBLE) AS answer FROM orders"""
)
def submission_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    answered = v.table(spark, sf, "orders").select(
        key.alias("pos"),
        F.concat(F.lit("Q"), key.cast("string")).alias("qid"),
        F.when(key % 4 != 0, F.col("o_totalprice").cast(answers.ANSWER)).alias("answer"),
    )
    rows = answers.submission_rows(answered)
    return rows.withColumn("answer", F.col("answer").cast("double")).orderBy("pos")
