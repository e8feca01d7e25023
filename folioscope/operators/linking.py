"""Priority linking: questions -> engineer, project, client, credential and parameters.

All questions are linked at once. Evidence of different strength is gathered as ranked rows and
one ``min_by`` per question picks the strongest; hard evidence (credential id, package number)
then overrides a name.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioscope.functions import fixed_values as fv, money, text as tx
from folioscope.operators.containment import contained_names, contained_words
from folioscope.operators.lookup import broadcast_checked, left_lookup
from folioscope.session import cut_lineage


def alias_table(spark: SparkSession, aliases: list[tuple[str, str]]) -> DataFrame:
    """(alias, canonical, alias_rank); a short list the caller supplies."""
    rows = [(a, c, i) for i, (a, c) in enumerate(aliases)]
    return spark.createDataFrame(rows, "alias string, canonical string, alias_rank int")


def first_alias(hits: DataFrame, aliases: DataFrame) -> DataFrame:
    """First alias (in list order) among a text's hits: (qid, canonical)."""
    known = aliases.withColumnRenamed("alias", "name")
    return hits.join(known, "name").groupBy("qid").agg(F.min_by("canonical", "alias_rank").alias("canonical"))


def longest_name(hits: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """The longest name of a catalog among a text's hits: (qid, name)."""
    known = names.select(F.col(name).alias("name")).distinct()
    order = F.struct(-F.length("name"), F.col("name"))
    return hits.join(known, "name").groupBy("qid").agg(F.min_by("name", order).alias(name))


def unique_first_names(engineers: DataFrame) -> DataFrame:
    """First names borne by exactly one person of the roster: (first, name)."""
    return _first_name_groups(engineers).filter("n_people = 1").select("first", F.col("first_bearer").alias("name"))


def _first_name_groups(engineers: DataFrame) -> DataFrame:
    return (
        engineers.filter(F.col("name").isNotNull())
        .groupBy(tx.first_name("name").alias("first"))
        .agg(
            F.count("*").alias("n_people"),
            F.min_by("name", "emp_id").alias("first_bearer"),
            F.min("emp_id").alias("first_emp_id"),
        )
    )


def led_title_words(works: DataFrame) -> DataFrame:
    """(lead, doc_id, word): the words of the titles of led works; repeated words stay repeated."""
    return works.filter(F.col("lead_engineer").isNotNull()).select(
        F.lower("lead_engineer").alias("lead"), "doc_id", F.explode(tx.title_words("project_name")).alias("word")
    )


def title_index(works: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Title words of led works, split by whether a word tells the lead's works apart.

    ``wanted``: (word), the words that occur in any text to be examined. Other words can't count for a text, so without
    them fewer wordings remain and every text still meets the same works with the same scores.

    Works of one lead whose titles agree in all shared words form a group, represented by its
    smallest doc_id. Returns (lead, group_doc, word, weight) for the shared words of each group
    and (lead, doc_id, group_doc, word, weight) for the words only one work has. A word such as
    'road' is thus listed once per distinct wording, not once per work.
    """
    titles = led_title_words(works)
    if wanted is not None:
        titles = titles.join(broadcast_checked(wanted), "word", "left_semi")
    counted = titles.groupBy("lead", "doc_id", "word").agg(F.count("*").alias("weight"))
    spread = counted.groupBy("lead", "word").agg((F.count("*") > 1).alias("shared"))
    flagged = cut_lineage(counted.join(spread, ["lead", "word"]))
    wording = F.array_sort(F.collect_list(F.when(F.col("shared"), F.struct("word", "weight"))))
    worded = flagged.groupBy("lead", "doc_id").agg(wording.alias("wording"))
    groups = cut_lineage(worded.groupBy("lead", "wording").agg(F.min("doc_id").alias("group_doc")))
    group_words = groups.select("lead", "group_doc", F.explode("wording").alias("w")).select(
        "lead", "group_doc", "w.word", "w.weight"
    )
    members = worded.join(groups, ["lead", "wording"]).select("lead", "doc_id", "group_doc")
    own_words = flagged.filter(~F.col("shared")).join(members, ["lead", "doc_id"]).drop("shared")
    return group_words, cut_lineage(own_words)


def title_overlap(
    word_hits: DataFrame, pairs: DataFrame, group_words: DataFrame, own_words: DataFrame, by: str = "lead"
) -> DataFrame:
    """Works whose titles share two or more words with the text: (qid, lead, doc_id, score).

    ``pairs``: (qid, lead) to examine; ``by`` names another column that both they and the titles
    have instead. ``word_hits``: (qid, word), the title words each text contains, also inside
    longer words. Of a group's works without words of their own in the text only the smallest
    doc_id is returned; the others score the same and come after it.
    """
    asked = pairs.select("qid", by).join(word_hits, "qid")
    by_group = asked.join(group_words, [by, "word"]).groupBy("qid", "lead", "group_doc").agg(
        F.sum("weight").alias("score")
    )
    own = asked.join(own_words, [by, "word"]).groupBy("qid", "lead", "group_doc", "doc_id").agg(
        F.sum("weight").alias("own")
    )
    with_own = own.join(by_group, ["qid", "lead", "group_doc"], "left").select(
        "qid", "lead", "doc_id", (F.col("own") + F.coalesce("score", F.lit(0))).alias("score")
    )
    alike = by_group.select("qid", "lead", F.col("group_doc").alias("doc_id"), "score")
    return with_own.unionByName(alike).filter("score >= 2")


def shared_first_names(first_hits: DataFrame, settled: DataFrame) -> DataFrame:
    """(qid, first): the first shared first name of each question that no stronger evidence settles.

    Namesakes: only that name of a question is examined, and it decides when the wording fits the works of exactly one
    bearer. Stronger evidence settles most questions before; the others meet bearers through title words, never the
    whole group.
    """
    return (
        first_hits.filter("n_people > 1")
        .join(settled, "qid", "left_anti")
        .groupBy("qid")
        .agg(F.min_by("first", "first_emp_id").alias("first"))
    )


def engineer_candidates(
    roster: DataFrame,
    full: DataFrame,
    alias_hits: DataFrame,
    first_hits: DataFrame,
    shared: DataFrame,
    holders: DataFrame,
    word_hits: DataFrame,
    titles: tuple[DataFrame, DataFrame],
) -> DataFrame:
    """Name evidence per question, strongest first: (qid, engineer).

    ``full`` (qid, name, emp_id), ``alias_hits`` (qid, canonical, alias_rank), ``first_hits`` (qid, n_people,
    first_bearer, first_emp_id), ``shared`` (qid, first) and ``holders`` (qid, name, doc_id): what each text names.
    ``word_hits``: (qid, word), title words the texts contain.
    """

    def ranked(df: DataFrame, priority: int, name: str, order: str) -> DataFrame:
        return df.select(
            "qid",
            F.lit(priority).alias("priority"),
            F.col(order).cast("string").alias("ord"),
            F.col(name).alias("engineer"),
        )

    of_first = [words.withColumn("first", tx.first_name("lead")) for words in titles]
    bearers = roster.select(F.lower("name").alias("lead"), F.col("name").alias("bearer")).distinct()
    fitting = (
        title_overlap(word_hits, shared, *of_first, by="first")
        .select("qid", "lead")
        .distinct()
        .join(bearers, "lead")
        .groupBy("qid")
        .agg(F.count("*").alias("n"), F.min("bearer").alias("bearer"))
        .filter("n = 1")
        .withColumn("ord", F.lit(""))
    )
    evidence = reduce(
        DataFrame.unionByName,
        [
            ranked(full, 1, "name", "emp_id"),
            # Zero-padded so that list order survives as text order.
            ranked(alias_hits.withColumn("ord", F.lpad(F.col("alias_rank").cast("string"), 9, "0")), 2, "canonical", "ord"),
            ranked(first_hits.filter("n_people = 1"), 3, "first_bearer", "first_emp_id"),
            ranked(fitting, 4, "bearer", "ord"),
            ranked(holders, 5, "name", "doc_id"),
        ],
    )
    return evidence.groupBy("qid").agg(F.min_by("engineer", F.struct("priority", "ord")).alias("engineer"))


def excluded_category(questions: DataFrame, works: DataFrame) -> DataFrame:
    """The most specific stored category whose words all occur outside the client's own name.

    ``questions``: (qid, question, client_name) -> (qid, excluded_category).
    """
    low = F.lower("question")
    masked = F.when(F.col("client_name").isNotNull(), F.replace(low, F.lower("client_name"), F.lit(" "))).otherwise(low)
    asked = questions.select(
        "qid", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit("[a-z]+"), F.lit(0)), tx.stem))).alias("word")
    )
    split_words = F.split(F.trim(F.lower("category")), r"\s+")
    # The same few words for every question: written, so that they are broadcast while they are few.
    known = cut_lineage(
        works.select("category")
        .distinct()
        .filter(tx.blank_to_null("category").isNotNull())
        .select("category", F.size(split_words).alias("n_listed"), F.array_distinct(F.transform(split_words, tx.stem)).alias("ws"))
        .select("category", "n_listed", F.size("ws").alias("n_words"), F.explode("ws").alias("word"))
    )
    return (
        asked.hint("merge").join(broadcast_checked(known), "word")
        .groupBy("qid", "category", "n_words", "n_listed")
        .agg(F.count("*").alias("n_found"))
        .filter("n_found = n_words")
        .groupBy("qid")
        .agg(F.min_by("category", F.struct(-F.col("n_listed"), F.col("category"))).alias("excluded_category"))
    )


def stored_category(c: Column | str, synonyms: dict[str, str] = fv.CATEGORY_SYNONYMS) -> Column:
    """Synonym -> stored category; anything else is taken as it is."""
    table = tx.literal_map(synonyms)
    return F.coalesce(F.element_at(table, F.lower(tx.as_col(c))), F.lower(tx.as_col(c)))


def category_spans(c: Column | str) -> Column:
    """Category mentions in text order, longest synonym first, never overlapping.

    Each synonym's occurrences are replaced by a numbered mark before shorter ones are tried.
    """
    text = F.lower(tx.as_col(c))
    by_length = sorted(fv.CATEGORY_SYNONYMS, key=len, reverse=True)
    for i, synonym in enumerate(by_length):
        text = F.regexp_replace(text, r"\b" + re.escape(synonym) + r"\b", f"\x01{i}\x02")
    marks = F.regexp_extract_all(text, F.lit("\x01([0-9]+)\x02"), F.lit(1))
    return F.transform(marks, lambda m: F.element_at(tx.literal_array(by_length), m.cast("int") + 1))


def credential_type_named(c: Column | str) -> Column:
    low = F.lower(tx.as_col(c))
    return F.when(F.contains(low, F.lit("six sigma")), fv.CREDENTIAL_SIX_SIGMA).when(
        F.contains(low, F.lit("pmp")), fv.CREDENTIAL_PMP
    )


def link_questions(
    questions: DataFrame,
    works: DataFrame,
    engineers: DataFrame,
    certs: DataFrame,
    clients: DataFrame,
    client_aliases: list[tuple[str, str]] = fv.CLIENT_ALIASES,
    engineer_aliases: list[tuple[str, str]] = fv.ENGINEER_ALIASES,
) -> DataFrame:
    """(qid, question, ...) -> the same rows with every linked entity and parameter."""
    spark = questions.sparkSession
    texts = questions.select("qid", F.trim("question").alias("question"))

    aliases = alias_table(spark, client_aliases)
    roster = engineers.filter(F.col("name").isNotNull())
    # Every catalog matched by plain containment is searched in one pass over the texts.
    searched_names = (
        engineers.select("name").union(certs.select("name")).union(clients.select("client_name")).union(aliases.select("alias"))
    )
    name_hits = cut_lineage(contained_names(texts, searched_names, "qid", "question", "name", literal=True))
    # Most hits are clients; those of people are few and feed several steps.
    people = cut_lineage(roster.select("name").union(certs.select("name")).distinct())
    person_hits = cut_lineage(name_hits.join(broadcast_checked(people), "name", "left_semi"))
    full = person_hits.join(roster.groupBy("name").agg(F.min("emp_id").alias("emp_id")), "name")
    holders = person_hits.join(certs.groupBy("name").agg(F.min("doc_id").alias("doc_id")), "name")
    # Aliases and first names count as whole words only; both are found in one pass.
    groups = cut_lineage(_first_name_groups(roster))
    nicknames = alias_table(spark, engineer_aliases)
    bounded = groups.select(F.col("first").alias("name")).union(nicknames.select("alias"))
    bounded_hits = cut_lineage(contained_names(texts, bounded, "qid", "question", "name", whole_words=True, literal=True))
    alias_hits = bounded_hits.withColumnRenamed("name", "alias").join(nicknames, "alias")
    first_hits = bounded_hits.withColumnRenamed("name", "first").join(groups, "first")
    settled = full.select("qid").union(alias_hits.select("qid")).union(first_hits.filter("n_people = 1").select("qid"))
    shared = cut_lineage(shared_first_names(first_hits, settled))

    # Questions that name a person, a credential or a package; nothing below can link the others to a work.
    mentions = texts.withColumns({"cid": tx.credential_id("question"), "pkg_no": tx.package_mention("question")})
    keyed = mentions.filter(F.col("cid").isNotNull() | F.col("pkg_no").isNotNull())
    linkable = cut_lineage(
        keyed.select("qid").union(person_hits.select("qid")).union(bounded_hits.select("qid")).distinct()
    )
    asked = cut_lineage(mentions.join(broadcast_checked(linkable), "qid", "left_semi"))
    unlinked = texts.join(broadcast_checked(linkable), "qid", "left_anti")

    # Titles are searched for questions without a package and for namesakes only.
    open_ones = asked.filter(F.col("pkg_no").isNull()).select("qid").union(shared.select("qid")).distinct()
    open_texts = cut_lineage(asked.select("qid", "question").join(open_ones, "qid", "left_semi"))
    vocabulary = led_title_words(works).select("word").distinct()
    word_hits = cut_lineage(contained_words(open_texts, vocabulary, "qid", "question", "word"))
    titles = title_index(works, cut_lineage(word_hits.select("word").distinct()))
    by_name = engineer_candidates(roster, full, alias_hits, first_hits, shared, holders, word_hits, titles)
    cert_by_id = (
        certs.withColumn("cid", tx.credential_id("cred_id"))
        .filter(F.col("cid").isNotNull())
        .groupBy("cid")
        .agg(F.min_by(F.struct("doc_id", "name", "issue_date"), "doc_id").alias("id_cert"))
    )
    packages = cut_lineage(asked.select(F.lower("pkg_no").alias("pkg")).filter(F.col("pkg").isNotNull()).distinct())
    work_by_package = (
        works.withColumn("pkg", F.lower("package_no"))
        .join(broadcast_checked(packages), "pkg", "left_semi")
        .groupBy("pkg")
        .agg(F.min_by(_work_struct(), "doc_id").alias("pkg_work"))
    )
    named = left_lookup(asked.withColumn("pkg", F.lower("pkg_no")).join(by_name, "qid", "left"), cert_by_id, ["cid"])
    named = left_lookup(named, work_by_package, ["pkg"]).withColumn(
        "engineer", F.coalesce("pkg_work.lead_engineer", "id_cert.name", "engineer")
    )
    named = cut_lineage(named)

    # Without a package, the engineer's own works are searched by title; a sole work is taken.
    searched = named.filter(F.col("pkg_no").isNull() & F.col("engineer").isNotNull()).select(
        "qid", F.lower("engineer").alias("lead")
    )
    best = title_overlap(word_hits, searched, *titles).groupBy("qid").agg(
        F.min_by("doc_id", F.struct(-F.col("score"), F.col("doc_id"))).alias("title_doc")
    )
    leads = cut_lineage(searched.select("lead").distinct())
    sole = (
        works.withColumn("lead", F.lower("lead_engineer"))
        .join(broadcast_checked(leads), "lead", "left_semi")
        .groupBy("lead")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("sole_doc"))
        .filter("n = 1")
        .select("lead", "sole_doc")
    )
    found = cut_lineage(
        searched.join(best, "qid", "left")
        .join(sole, "lead", "left")
        .select("qid", F.coalesce("title_doc", "sole_doc").alias("found_doc"))
        .filter(F.col("found_doc").isNotNull())
    )
    chosen = (
        works.select(F.col("doc_id").alias("found_doc"), _work_struct().alias("found_work"))
        .join(broadcast_checked(found), "found_doc")
        .select("qid", "found_work")
    )
    with_work = (
        named.join(chosen, "qid", "left")
        .withColumn("work", F.coalesce("pkg_work", "found_work"))
        .drop("pkg_work", "found_work", "pkg", "cid")
    )
    cert_by_holder = certs.groupBy(F.lower("name").alias("holder"), F.lower("cred_type").alias("kind")).agg(
        F.min_by(F.struct("doc_id", "name", "issue_date"), "doc_id").alias("held_cert")
    )
    of_holder = with_work.withColumns({"holder": F.lower("engineer"), "kind": F.lower(credential_type_named("question"))})
    with_cert = left_lookup(of_holder, cert_by_holder, ["holder", "kind"]).withColumn("cert", F.coalesce("id_cert", "held_cert"))
    found_rows = with_cert.select(
        "qid",
        "question",
        "engineer",
        F.col("work.client_name").alias("work_client"),
        F.col("work.doc_id").alias("project_doc_id"),
        F.col("work.project_name").alias("project_name"),
        F.coalesce("pkg_no", "work.package_no").alias("package_no"),
        F.col("work.completion_date").alias("completion_date"),
        F.col("cert.doc_id").alias("cert_doc_id"),
        F.col("cert.issue_date").alias("issue_date"),
    )
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in found_rows.schema if f.name not in ("qid", "question")]

    exact_client = longest_name(name_hits, clients, "client_name")
    aliased = first_alias(name_hits, aliases).withColumnRenamed("canonical", "alias_client")
    with_client = cut_lineage(
        found_rows.unionByName(unlinked.select("qid", "question", *nothing))
        .join(exact_client, "qid", "left")
        .join(aliased, "qid", "left")
        .withColumn("client_name", F.coalesce("client_name", "alias_client", "work_client"))
        .drop("alias_client", "work_client")
    )
    excluded = excluded_category(with_client.select("qid", "question", "client_name"), works)
    linked = with_client.join(excluded, "qid", "left").select(
        "qid",
        "engineer",
        "client_name",
        "project_doc_id",
        "project_name",
        "package_no",
        "completion_date",
        "cert_doc_id",
        "issue_date",
        credential_type_named("question").alias("cred_type"),
        money.threshold_rupees("question").alias("threshold_inr"),
        "excluded_category",
        tx.years_in("question").alias("years"),
    )
    return questions.join(linked, "qid", "left")


def _work_struct() -> Column:
    return F.struct("doc_id", "project_name", "package_no", "client_name", "completion_date", "lead_engineer")
