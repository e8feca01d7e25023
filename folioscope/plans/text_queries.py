"""Registered queries over text: parsing, normalising, classifying and extracting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import dates, fixed_values as fv, money, tableqa, text as tx
from folioscope.operators import classify, extract, merge
from folioscope.plans import rendered as r, views as v
from folioscope.schemas import conform_works

QUERIES: dict = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


# --- rendered numbers and dates ---------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS parsed,
              -CAST(round(o_totalprice * 100) AS BIGINT) AS parsed_negative FROM orders"""
)
def money_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    value, key = v.cents(F.col("o_totalprice")), F.col("o_orderkey")
    rendered = v.table(spark, sf, "orders").select(
        key.alias("id"),
        r.money_text(value, key).alias("txt"),
        F.concat(F.lit("-"), money.indian_grouping(value)).alias("negative"),
    )
    return rendered.select(
        "id", money.parse_money("txt").alias("parsed"), money.parse_money("negative").alias("parsed_negative")
    )


@query(
    """SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 3 = 0 THEN (p_size + 1) * 10000000
              WHEN p_partkey % 3 = 1 THEN (p_size + 1) * 100000 ELSE p_size % 10 * 10000000 + 200000000 END AS BIGINT) AS bar,
              CASE WHEN p_partkey % 3 = 2 AND p_size % 10 > 0 THEN 20 + p_size % 10
                   WHEN p_partkey % 3 = 2 THEN 20 ELSE 0 END AS spoken
       FROM part"""
)
def threshold_words(spark: SparkSession, sf: str) -> DataFrame:
    units = F.array(*[F.lit(w) for w in ["", *["-" + u for u in fv.UNIT_WORDS]]])
    size, key = F.col("p_size"), F.col("p_partkey")
    phrase = F.concat(F.lit("twenty"), F.element_at(units, size % 10 + 1))
    text = (
        F.when(key % 3 == 0, F.concat(F.lit("at least "), (size + 1).cast("string"), F.lit(".0 Cr overall")))
        .when(key % 3 == 1, F.concat((size + 1).cast("string"), F.lit(" lakhs or more")))
        .otherwise(F.concat(F.lit("the "), phrase, F.lit(" crore line")))
    )
    return v.table(spark, sf, "part").select(
        key.alias("id"),
        money.threshold_rupees(text).alias("bar"),
        F.when(key % 3 == 2, money.words_to_number(phrase)).otherwise(0).alias("spoken"),
    )


@query(
    """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS parsed, CAST(o_orderdate AS DATE) AS embedded FROM orders"""
)
def date_formats(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    inside = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        dates.parse_date(r.date_text(day, F.col("o_orderkey"))).alias("parsed"),
        dates.parse_date(F.concat(F.lit("issued (on) "), inside, F.lit(" at noon"))).alias("embedded"),
    )


# --- scalar text functions over whole documents ---------------------------------------------------------


@query(
    r"""SELECT doc_id,
               trim(regexp_replace(replace(replace(text, '–', '—'), chr(65533), '—'), '\s+', ' ', 'g')) AS normal,
               trim(regexp_replace(regexp_replace(lower(text), '[^\pL\pM\p{Nd}\p{Pc}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS category,
               trim(regexp_replace(trim(regexp_replace(replace(replace(text, '–', '—'), chr(65533), '—'), '\s+', ' ', 'g')),
                    '\s*\([^)]*\)', '', 'g')) AS client
        FROM documents"""
)
def text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "documents").select(
        "doc_id",
        tx.normalize_text("text").alias("normal"),
        tx.clean_category("text").alias("category"),
        tx.clean_client_name("text").alias("client"),
    )


STATE_SQL = "CASE " + " ".join(f"WHEN contains(lower(t), '{s.lower()}') THEN '{s}'" for s in fv.STATES) + " END"


@query(
    f"""SELECT o_orderkey AS id, {STATE_SQL} AS state, concat('Pkg-', o_orderkey) AS package,
               concat('Pkg-', o_orderkey) AS mention, concat('PMI-', o_custkey) AS credential
        FROM (SELECT *, {r.title_sql('o_orderkey')} AS t FROM orders)"""
)
def package_state_extract(spark: SparkSession, sf: str) -> DataFrame:
    title = r.title("o_orderkey")
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        tx.state_name(title).alias("state"),
        tx.package_number(title).alias("package"),
        tx.package_mention(F.concat(F.lit("about package - "), F.col("o_orderkey").cast("string"))).alias("mention"),
        tx.credential_id(F.concat(F.lit("holder (pmi-"), F.col("o_custkey").cast("string"), F.lit(") of it"))).alias("credential"),
    )


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in fv.NAME_STOPWORDS) + "]"
NAME_WORDS_SQL = f"""list_sort(list_distinct(list_transform(
    list_filter(list_transform(regexp_extract_all({{c}}, '[A-Za-z]+'), lambda x: lower(x)),
                lambda x: length(x) > 2 AND NOT list_contains({STOP_SQL}, x)),
    lambda x: CASE WHEN length(x) > 3 AND x[-1] = 's' THEN x[:-2] ELSE x END)))"""


@query(f"SELECT doc_id, array_to_string({NAME_WORDS_SQL.format(c='text')}, ' ') AS words FROM documents")
def word_sets(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_join(F.array_sort(tx.name_words("text")), " ")
    return v.table(spark, sf, "documents").select("doc_id", words.alias("words"))


ACRONYM_SKIP_SQL = "[" + ", ".join(f"'{w}'" for w in fv.NAME_STOPWORDS if w not in fv.ACRONYM_LETTER_WORDS) + "]"
ACRONYMS_SQL = f"""list_sort(list_distinct(list_filter(flatten(list_transform(
    list_concat([{{c}}], string_split({{c}}, ',')),
    lambda p: [array_to_string(list_transform(regexp_extract_all(p, '[A-Za-z]+'), lambda w: upper(w[1])), ''),
               array_to_string(list_transform(list_filter(regexp_extract_all(p, '[A-Za-z]+'),
                   lambda w: NOT list_contains({ACRONYM_SKIP_SQL}, lower(w))), lambda w: upper(w[1])), '')])),
    lambda a: length(a) >= 2)))"""
FUNCTION_WORDS_SQL = "[" + ", ".join(f"'{w.upper()}'" for w in fv.FUNCTION_WORDS) + "]"


@query(
    f"""SELECT item_id, array_to_string({ACRONYMS_SQL.format(c='text')}, ' ') AS acronyms,
               array_to_string(list_sort(list_distinct(list_transform(list_filter(
                   regexp_split_to_array(text, '[^\\pL\\pN_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{{2,6}}')
                   AND NOT list_contains({FUNCTION_WORDS_SQL}, upper(x))), lambda x: upper(x)))), ' ') AS tokens
        FROM benchmark"""
)
def acronyms(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "benchmark").select(
        "item_id",
        F.array_join(tx.acronyms("text"), " ").alias("acronyms"),
        F.array_join(F.array_sort(tx.acronym_tokens("text")), " ").alias("tokens"),
    )


# --- classification -----------------------------------------------------------------------------------------


def any_sql(column: str, phrases: list[str]) -> str:
    quoted = [p.replace("'", "''") for p in phrases]
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in quoted) + ")"


@query(
    """WITH d AS (
           SELECT lower(text) AS t FROM documents
           UNION ALL SELECT 'completion certificate' FROM orders
           UNION ALL SELECT 'to whomsoever it may concern' FROM customer
           UNION ALL SELECT 'pmp holder' FROM supplier)
       SELECT cls, count(*) AS n_docs FROM (
           SELECT CASE WHEN contains(substr(t, 1, 400), 'checklist') OR contains(substr(t, 1, 400), 'compliance')
                         OR contains(substr(t, 1, 400), 'tender') OR contains(substr(t, 1, 400), 'dossier') THEN 'unknown'
                       WHEN contains(t, 'pmp') OR (contains(t, 'six sigma') AND contains(t, 'black belt')) THEN 'personnel_certificate'
                       WHEN contains(t, 'curriculum vitae') OR contains(t, 'key personnel') THEN 'cv'
                       WHEN contains(t, 'whomsoever') OR contains(t, 'letter of recommendation')
                         OR contains(t, 'reference letter') THEN 'reference_letter'
                       WHEN contains(t, 'completion') AND contains(t, 'certificate') THEN 'completion_certificate_any'
                       ELSE 'unknown' END AS cls FROM d) GROUP BY cls"""
)
def doc_class_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Real documents together with rendered certificates, letters and credentials."""
    certificates = r.certificate_pages(spark, sf).filter("page_no = 1").select("text")
    letters = v.table(spark, sf, "customer").select(
        F.concat(F.lit("TO WHOMSOEVER it may concern: "), "c_name").alias("text")
    )
    creds = v.table(spark, sf, "supplier").select(F.concat(v.person_name("s_suppkey"), F.lit(" is a PMP holder")).alias("text"))
    docs = v.table(spark, sf, "documents").select("text").union(certificates).union(letters).union(creds)
    return classify.class_histogram(classify.classify_pages(docs, "text"))


def shape_sql(q: str, raw: str, kind: str) -> str:
    has = lambda phrases: any_sql(q, phrases)
    years = f"length(list_distinct(regexp_extract_all({q}, '\\b(?:201[0-9]|202[0-9])\\b')))"
    terms = " + ".join(f"CAST(contains({q}, '{t}') AS INTEGER)" for t in fv.CATEGORY_TERMS)
    tens = "|".join(w for w in fv.NUMBER_WORDS if w != "hundred")
    amount = (
        f"(regexp_matches({raw}, '(?i)[0-9]\\s*cr(?:ore)?s?\\b') OR regexp_matches({raw}, '(?i)(?:{tens})(?:[\\s-](?:"
        + "|".join(fv.UNIT_WORDS)
        + f"))?\\s+crore') OR regexp_matches({raw}, '(?i)[0-9]\\s*lakhs?\\b'))"
    )
    rules = [
        (f"{kind} = 'days'", "date_span"),
        (f"{kind} = 'count' AND {has(fv.ABSENCE_WORDS)}", "absence"),
        (f"{kind} = 'count'", "distinct_count"),
        (f"{kind} = 'percent' AND {has(fv.ENDORSEMENT_WORDS)}", "referenced_share"),
        (f"{kind} = 'percent' AND {has(fv.COLLECTION_WORDS)}", "collection_rate"),
        (f"{kind} = 'percent'", "referenced_share"),
        (f"{has(fv.AFTER_PHRASES)} AND {has(fv.AFTER_DATE_WORDS)}", "temporal_chain"),
        (has(fv.EXCLUSION_PHRASES), "exclusion_aggregate"),
        (f"{has(fv.MEAN_WORDS)} AND {has(['median'])}", "mean_vs_median"),
        (
            f"({has(fv.BALANCE_PHRASES)} OR (contains({q}, 'still outstanding') AND {has(fv.CHARGE_WORDS)})"
            f" OR (contains({q}, 'currently due') AND {has(fv.CHARGE_WORDS)})) AND NOT {has(fv.AWARD_WORDS)}",
            "outstanding_balance",
        ),
        (f"{years} >= 2", "annual_diff"),
        (f"({terms}) >= 2 AND NOT {has(['median', '201', '202', 'largest'])}", "category_diff"),
        (f"({has(fv.SHORTFALL_PHRASES)} AND {has(fv.SHORTFALL_OBJECTS)}) OR {has(fv.SHORTFALL_ALONE)}", "billing_shortfall"),
        (has(fv.AVERAGE_SIZE_PHRASES), "avg_work_size"),
        (f"{has(fv.LARGEST_WORDS)} AND {has(fv.RUNNER_UP_WORDS)}", "rank_value"),
        (has(fv.TARGET_GAP_PHRASES), "gap_to_threshold"),
        (
            f"({has(fv.BAR_PHRASES)} OR (contains({q}, 'line') AND NOT contains({q}, 'line item')))"
            f" AND {has(fv.BAR_UNIT_WORDS)} AND {amount}",
            "threshold_aggregate",
        ),
    ]
    return "CASE " + " ".join(f"WHEN {cond} THEN '{shape}'" for cond, shape in rules) + " ELSE 'hop_aggregate' END"


@query(
    f"""WITH {r.client_questions_sql()},
        asked AS (
            SELECT qid, question, answer_type FROM client_questions
            UNION ALL SELECT concat('t-', conv_id, '-', turn, '-', k), text, k FROM conversations,
                (VALUES ('money'), ('count'), ('percent'), ('days')) AS x(k))
        SELECT qid, {shape_sql('lower(question)', 'question', 'answer_type')} AS shape FROM asked"""
)
def shape_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered questions, and every conversation turn taken as a question of each answer type."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("money", "count", "percent", "days")])).alias("answer_type")
    said = v.spread(v.table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    turns = said.select("conv_id", "turn", F.col("text").alias("question"), kinds).select(
        F.concat_ws("-", F.lit("t"), "conv_id", "turn", "answer_type").alias("qid"), "question", "answer_type"
    )
    asked = r.client_questions(spark, sf).select("qid", "question", "answer_type").unionByName(turns)
    return classify.with_shape(asked).select("qid", "shape")


@query(
    f"""WITH {r.client_questions_sql()}
        SELECT {shape_sql('lower(question)', 'question', 'answer_type')} AS shape, count(*) AS n
        FROM client_questions GROUP BY 1"""
)
def shape_histogram(spark: SparkSession, sf: str) -> DataFrame:
    shapes = classify.with_shape(r.client_questions(spark, sf))
    return shapes.groupBy("shape").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape")


FIGURE_SQL = "regexp_matches(question, '(?i)[0-9]+(\\.[0-9]+)?\\s*cr\\b|\\blakh\\b')"
GAP_SQL = (
    f"(({any_sql('q', fv.DIRECTION_WORDS)} OR contains(q, 'credential')) AND (contains(q, 'crore') OR {FIGURE_SQL})"
    f" AND {any_sql('q', fv.GAP_WORDS)})"
)


@query(
    f"""WITH {r.client_questions_sql()},
        asked AS (SELECT qid, question, lower(question) AS q FROM client_questions
                  UNION ALL SELECT concat('d-', doc_id), text, lower(text) FROM documents)
        SELECT qid, {any_sql('q', fv.ROLLUP_PHRASES)} AS is_rollup,
               {any_sql('q', ['median', *fv.DIFFERENCE_PHRASES])} AS is_difference,
               {any_sql('q', ['median', *fv.SECOND_LARGEST_PHRASES])} AS needs_all_rows,
               {any_sql('q', fv.BILLING_PHRASES)} AS is_billing,
               {FIGURE_SQL} AS has_currency_unit,
               {GAP_SQL} AS is_threshold_gap,
               {any_sql('q', fv.DIRECTION_WORDS)} AND (contains(q, 'crore') OR {FIGURE_SQL}) AND NOT {GAP_SQL}
                   AS is_threshold_direction
        FROM asked"""
)
def scope_flags(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select(
        F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("qid"), F.col("text").alias("question")
    )
    asked = r.client_questions(spark, sf).select("qid", "question").unionByName(docs)
    return classify.flag_questions(asked).drop("question")


# --- extraction ----------------------------------------------------------------------------------------------


@query(
    f"""SELECT concat('DOC-', o_orderkey) AS doc_id, concat('Pkg-', o_orderkey) AS package_no,
               {r.title_sql('o_orderkey')} AS project_name, concat('CLIENT ', o_custkey) AS client_name,
               {v.category_name_sql()} AS category, CAST(round(o_totalprice * 100) AS BIGINT) AS value_inr,
               CAST(o_orderdate AS DATE) AS completion_date, {v.person_name_sql('o_custkey')} AS lead_engineer,
               {r.WORK_STATES!r}[CAST(o_orderkey % {len(r.WORK_STATES)} + 1 AS INTEGER)] AS state, 4 AS completeness
        FROM orders"""
)
def label_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Two-page certificates in four layouts -> typed works."""
    docs = extract.document_texts(r.certificate_pages(spark, sf))
    return extract.certificate_records(docs).select(
        "doc_id", "package_no", "project_name", "client_name", "category", "value_inr", "completion_date",
        "lead_engineer", "state", "completeness",
    )


@query(
    r"""SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title,
               nullif(trim(regexp_extract(html, '<html lang="([^"]*)"', 1)), '') AS lang,
               nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '') AS heading FROM pages"""
)
def html_field_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The same labelled-field extraction over raw pages."""
    patterns = {"title": "<title>([^<]*)</title>", "lang": '<html lang="([^"]*)"', "heading": "<h1>([^<]*)</h1>"}
    return v.table(spark, sf, "pages").select(
        "page_id", *[extract.find("html", p).alias(name) for name, p in patterns.items()]
    )


@query(
    f"""SELECT concat('PC-', event_id) AS doc_id, {v.person_name_sql('user_id')} AS name,
               CASE WHEN event_id % 2 = 0 THEN concat('EMP-', user_id) END AS emp_id,
               CASE WHEN event_id % 2 = 0 THEN 'PMP' ELSE 'Six Sigma Black Belt' END AS cred_type,
               concat('PMI-', event_id) AS cred_id, CAST(ts AS DATE) AS issue_date,
               CAST(CAST(ts AS DATE) + INTERVAL 1000 DAY AS DATE) AS valid_through
        FROM events WHERE event_type = 'signup'"""
)
def credential_extract(spark: SparkSession, sf: str) -> DataFrame:
    issued = F.date_format("issue_date", "yyyy-MM-dd")
    until = F.date_format(F.date_add("issue_date", 1000), "d MMMM yyyy")
    person, event = F.col("person").cast("string"), F.col("event_id").cast("string")
    first = F.concat(
        F.lit("PMP credential\nThis is to certify that\n"), v.person_name("person"), F.lit("\nEmployee ID: EMP-"), person,
        F.lit("\nCredential ID: PMI-"), event, F.lit("\nIssued: "), issued, F.lit("\nValid Through\n"), until,
    )
    second = F.concat(
        F.lit("Six Sigma Black Belt\nThis credential is conferred upon\n"), v.person_name("person"),
        F.lit("\nCertificate No.\nPMI-"), event, F.lit("\nIssued\n"), F.date_format("issue_date", "MMMM d, yyyy"),
        F.lit("\nValid Through\n"), until,
    )
    docs = v.certs(spark, sf).select(
        F.concat(F.lit("PC-"), event).alias("doc_id"), F.when(F.col("event_id") % 2 == 0, first).otherwise(second).alias("page1")
    )
    return extract.credential_records(docs)


@query(
    f"""SELECT {v.person_name_sql('s_suppkey')} AS name, concat('EMP-', s_suppkey) AS emp_id,
               concat('Manager ', s_nationkey) AS designation, 'Roads' AS business_unit, '12 years' AS experience_years,
               'B.E.' AS qualification, DATE '2014-08-23' AS date_of_joining FROM supplier"""
)
def cv_extract(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(
        F.lit("CURRICULUM VITAE\nName "), v.person_name("s_suppkey"), F.lit("\nEmployee ID EMP-"), F.col("s_suppkey").cast("string"),
        F.lit("\nDesignation Manager "), F.col("s_nationkey").cast("string"),
        F.lit("\nBusiness Unit Roads\nTotal Experience 12 years\nQualification B.E.\nDate of Joining August 23, 2014\n"),
    )
    docs = v.table(spark, sf, "supplier").select(F.concat(F.lit("CV-"), F.col("s_suppkey").cast("string")).alias("doc_id"), page.alias("page1"))
    return extract.cv_records(docs)


LETTERS_SQL = """SELECT l_orderkey, concat('RL-', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), '-', l_linenumber) AS doc_id
                 FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber"""


@query(
    f"""WITH letters AS ({LETTERS_SQL}), last AS (SELECT l_orderkey, max(doc_id) AS doc_id FROM letters GROUP BY l_orderkey)
        SELECT o_orderkey AS work_id, last.doc_id IS NOT NULL AS has_reference_letter, last.doc_id AS ref_letter_doc_id
        FROM orders LEFT JOIN last ON last.l_orderkey = o_orderkey"""
)
def letter_match(spark: SparkSession, sf: str) -> DataFrame:
    """Reference letters -> package -> work; the last letter of a work is kept on it."""
    key = F.col("l_orderkey").cast("string")
    pages = (
        v.table(spark, sf, "lineitem")
        .filter("l_returnflag = 'R'")
        .select("l_orderkey", "l_linenumber")
        .distinct()
        .select(
            F.concat(F.lit("RL-"), F.lpad(key, 12, "0"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("doc_id"),
            F.concat(F.lit("\n Client office\nTo whomsoever it may concern\nre: pkg"), key, F.lit(", done well")).alias("page1"),
        )
    )
    works = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.concat(F.lit("Pkg-"), F.col("o_orderkey").cast("string")).alias("package_no"),
        r.title("o_orderkey").alias("project_name"),
    )
    matched = merge.match_letters(extract.letter_records(pages), works)
    return merge.flag_references(works, matched).select(
        F.col("doc_id").cast("bigint").alias("work_id"), "has_reference_letter", "ref_letter_doc_id"
    )


@query(
    """SELECT concat('INV-', l_orderkey, '-', l_linenumber) AS invoice_no, concat('Client ', l_suppkey) AS client_name,
              concat('Client ', l_suppkey, ' (Govt)') AS raw_client_name, CAST(l_shipdate AS DATE) AS invoice_date,
              CAST(round(l_extendedprice * 100) AS BIGINT) AS invoiced_inr, l_linestatus AS status,
              CAST(l_quantity AS BIGINT) AS received_inr, -CAST(l_quantity AS BIGINT) AS outstanding_inr
       FROM lineitem WHERE l_returnflag <> 'A'"""
)
def receivables_conform(spark: SparkSession, sf: str) -> DataFrame:
    """An ageing sheet: mixed text and numeric money cells, rows without a client skipped."""
    return extract.conform_receivables_sheet(r.receivables_sheet(spark, sf))


@query(
    """SELECT CAST(p_partkey AS INTEGER) AS asset_id, p_type AS asset_type, p_brand AS make,
              CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2000 + p_size END AS acquired_year,
              CAST(round_even(p_retailprice, 0) AS BIGINT) AS cost_inr, 'Good' AS condition, p_name AS location,
              'Owned' AS ownership, p_partkey % 2 = 0 AS safety_certified
       FROM part WHERE p_partkey % 5 <> 4"""
)
def asset_conform(spark: SparkSession, sf: str) -> DataFrame:
    return extract.conform_asset_sheet(r.asset_sheet(spark, sf))


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, {r.title_sql('o_orderkey')} AS project_name,
               concat('Client ', o_custkey) AS client_name, {v.category_name_sql()} AS category,
               CAST(round(o_totalprice * 100) AS BIGINT) AS value_inr,
               CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS completion_date
        FROM orders"""
)
def schema_conform(spark: SparkSession, sf: str) -> DataFrame:
    """Raw fields next to typed ones: raw text wins, otherwise the typed value is kept."""
    value, even = v.cents(F.col("o_totalprice")), F.col("o_orderkey") % 2 == 0
    raw = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("doc_id"),
        r.title("o_orderkey").alias("project_name"),
        F.concat(F.lit(" Client  "), F.col("o_custkey").cast("string"), F.lit(" (Govt)")).alias("client_name"),
        F.upper(v.category_name()).alias("category"),
        F.when(even, F.concat(F.lit("INR "), money.indian_grouping(value))).alias("value_raw"),
        F.when(even, F.lit(0)).otherwise(value).alias("value_inr"),
        F.when(even, F.date_format("o_orderdate", "d MMM yyyy")).alias("completion_date_raw"),
    )
    return conform_works(raw).select("doc_id", "project_name", "client_name", "category", "value_inr", "completion_date")


# --- merging -----------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS work_id, CASE WHEN upper_only THEN upper(c_name) ELSE c_name END AS client_name
       FROM orders JOIN (SELECT c_custkey, c_name, c_custkey % 3 = 0 AS upper_only FROM customer) c ON c_custkey = o_custkey"""
)
def canonical_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Works print every name in capitals; the ledger has the mixed spelling for some clients."""
    names = v.table(spark, sf, "customer").select("c_custkey", "c_name")
    works = v.table(spark, sf, "orders").join(names, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("work_id"), F.upper("c_name").alias("client_name")
    )
    ledger = names.select(
        F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("client_name")
    )
    spellings = merge.canonical_spellings([(works, "client_name"), (ledger, "client_name")])
    return merge.apply_canonical(works, "client_name", spellings)


@query(
    """WITH RECURSIVE recs AS (
           SELECT user_id AS pkg, CAST(round(value * 100) AS BIGINT) + 1 AS v,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id) AS pos,
                  CASE WHEN event_type = 'error' THEN concat('Client ', event_id) END AS client
           FROM events),
       fold AS (
           SELECT pkg, pos, v FROM recs WHERE pos = 1
           UNION ALL
           SELECT f.pkg, r.pos, CASE WHEN abs(r.v - f.v) < 1000 THEN r.v ELSE f.v END
           FROM fold f JOIN recs r ON r.pkg = f.pkg AND r.pos = f.pos + 1),
       clients AS (SELECT pkg, arg_min(client, pos) AS client_name FROM recs WHERE client IS NOT NULL GROUP BY pkg)
       SELECT f.pkg AS package_no, arg_max(f.v, f.pos) AS value_inr, any_value(client_name) AS client_name
       FROM fold f LEFT JOIN clients c ON c.pkg = f.pkg GROUP BY f.pkg"""
)
def record_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Events as many records of one work, with values that drift in steps below the tolerance."""
    records = v.table(spark, sf, "events").select(
        F.col("user_id").alias("package_no"),
        (F.col("event_id") % 3).cast("int").alias("completeness"),
        F.col("event_id").alias("seq"),
        (v.cents(F.col("value")) + 1).alias("value_inr"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Client "), F.col("event_id").cast("string"))).alias("client_name"),
    )
    return merge.merge_records(records).select("package_no", "value_inr", "client_name")


# --- table questions -----------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 6
              WHEN 0 THEN a - b WHEN 1 THEN CASE WHEN b <> 0 THEN round_even((a - b) / b * 100, 2) ELSE a END
              WHEN 2 THEN a + b + c WHEN 3 THEN round_even((a + b + c) / 3, 2)
              WHEN 4 THEN CASE WHEN b <> 0 THEN round_even(a / b, 4) ELSE a END ELSE a * b * c END AS result,
              CASE WHEN o_orderkey % 2 = 0 THEN '2' ELSE o_orderstatus END AS answer
       FROM (SELECT *, CAST(o_custkey AS DOUBLE) AS a, CAST(o_orderkey % 7 AS DOUBLE) AS b, 3.0::DOUBLE AS c FROM orders)"""
)
def table_arith(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("subtract", "percent_change", "sum", "average", "divide", "multiply")])
    operands = F.array(F.col("o_custkey").cast("double"), (key % 7).cast("double"), F.lit(3.0))
    spans = F.when(key % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array("o_orderstatus"))
    kind = F.when(key % 2 == 0, "count").otherwise("span")
    operation = F.element_at(names, (key % 6 + 1).cast("int"))
    return v.table(spark, sf, "orders").select(
        key.alias("id"),
        tableqa.arithmetic(operands, operation).alias("result"),
        F.array_join(tableqa.answer_by_kind(kind, spans, operands, operation), ",").alias("answer"),
    )


@query(
    """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS paragraphs,
              string_agg(concat(role, ' | ', turn), chr(10) ORDER BY turn) AS table_text
       FROM conversations GROUP BY conv_id"""
)
def paragraph_format(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's turns as the paragraphs and the table of one document."""
    gathered = v.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.collect_list(F.struct(F.col("turn").cast("int").alias("order"), "text")).alias("paragraphs"),
        F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("rows"),
    )
    cells = F.transform("rows", lambda x: F.array(x["role"], x["turn"].cast("string")))
    return gathered.select(
        "conv_id",
        tableqa.format_paragraphs("paragraphs").alias("paragraphs"),
        tableqa.format_table(cells).alias("table_text"),
    )
