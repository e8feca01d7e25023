"""Abstaining name resolution: exact, acronym and fuzzy tiers over whole question tables.

A resolve result is (matched, confidence, tied, method): ``matched`` for one clear winner,
``tied`` when several candidates cannot be told apart, neither when nothing fits.
Every tier is an equi-join on tokens or acronyms; questions settled by an earlier tier leave the
later ones through an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.functions.text import (
    acronym_tokens, acronyms, name_words, package_mention, stem, without_words,
    words as plain_words,
)
from folioscope.operators.containment import contained_names
from folioscope.operators.lookup import broadcast_checked
from folioscope.session import cut_lineage

MIN_SCORE, MIN_MARGIN = 0.3, 0.15
TIE_MIN_SCORE, TIE_MIN_MARGIN = 0.15, 0.1
SAME_OVERLAP, OVERLAP_DIGITS = 1e-9, 10
CONFIDENCE = {"exact": 1.0, "acronym": 0.95}

# Scoped resolution carries a pool id on both sides; an unscoped catalog is one pool.
POOL = "_pool"


def _with_pool(df: DataFrame, pool: str | None) -> DataFrame:
    return df.withColumn(POOL, F.col(pool) if pool else F.lit(""))


def _qualified(scores: DataFrame) -> DataFrame:
    """Keep pairs with two shared words, or one that no other candidate has."""
    return scores.filter((F.col("n_shared") >= 2) | ((F.col("n_shared") == 1) & (F.col("min_df") == 1))).select(
        "qid", "name", "overlap", (F.col("overlap") / F.col("total")).alias("frac")
    )


def decide(scores: DataFrame, min_score: float, min_margin: float) -> DataFrame:
    """(qid, name, overlap, frac) -> (qid, matched, confidence, tied), abstaining on close calls.

    Two mergeable aggregations: the leader per question, then everything relative to it. Names
    are gathered for the questions that end in a tie only. Sums of the same weights may differ in their last digit with
    the order they are added in, so overlaps are rounded before they are ranked.
    """
    scores = cut_lineage(scores.withColumn("overlap", F.round("overlap", OVERLAP_DIGITS)))
    rank = F.struct("overlap", "frac")
    leaders = scores.groupBy("qid").agg(F.max(F.struct("overlap", "frac", "name")).alias("top"))
    top_overlap, top_frac = F.col("top.overlap"), F.col("top.frac")
    same = F.abs(F.col("overlap") - top_overlap) < SAME_OVERLAP
    near = top_frac - F.col("frac") < min_margin
    others = F.col("name") != F.col("top.name")
    summary = (
        scores.join(leaders.filter(top_frac >= min_score), "qid")
        .groupBy("qid")
        .agg(
            F.first("top").alias("top"),
            F.count_if(same).alias("n_same"),
            F.max(F.when(others, rank)).alias("runner"),
        )
    )
    margin = top_frac - F.coalesce(F.col("runner.frac"), F.lit(0.0))
    settled = (F.col("n_same") < 2) & (margin >= min_margin)
    judged = cut_lineage(summary.select("qid", "top", "n_same", settled.alias("settled")))
    ties = (
        scores.join(judged.filter("not settled"), "qid")
        .filter(F.when(F.col("n_same") >= 2, same).otherwise(near))
        .groupBy("qid")
        .agg(F.array_sort(F.collect_set("name")).alias("tied"))
    )
    return judged.join(ties, "qid", "left").select(
        "qid",
        F.when(F.col("settled"), F.col("top.name")).alias("matched"),
        top_frac.alias("confidence"),
        F.coalesce("tied", F.array().cast(ties.schema["tied"].dataType)).alias("tied"),
    )


def shared_words(asked: DataFrame, postings: DataFrame, scope: list[str]) -> DataFrame:
    """Join question words with name words: (qid, name, overlap, n_shared, min_df).

    ``asked``: (qid, *scope, word). ``postings``: (*scope, name, word, df, weight, solo), where
    ``solo`` marks words that qualify a pair on their own. All other pairs need two shared words,
    so the most common word of each name never has to generate a pair: it is looked up afterwards
    for the pairs the rarer words produced. That keeps every name's hottest token out of the join.
    Where the names' words are few, a question's pairs are made and summed up in one task.
    """
    by = [*scope, "name"]
    common = cut_lineage(
        postings.groupBy(*by)
        .agg(F.max(F.struct("df", "word", "weight", "solo")).alias("c"))
        .filter(~F.col("c.solo"))
        .select(*by, F.col("c.word").alias("c_word"), F.col("c.df").alias("c_df"), F.col("c.weight").alias("c_weight"))
    )
    generators = cut_lineage(
        postings.join(common.select(*by, "c_word"), by, "left")
        .filter(F.col("c_word").isNull() | (F.col("word") != F.col("c_word")))
        .drop("c_word")
    )
    hinted = broadcast_checked(generators)
    few = hinted is not generators
    # Pairs are many more than words: not moved at all if the words are dealt by question before.
    partitions = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    generated = (
        (asked.repartition(partitions, "qid") if few else asked).join(hinted, [*scope, "word"])
        .groupBy("qid", *by)
        .agg(
            F.sum("weight").alias("overlap"), F.count("*").alias("n_shared"), F.min("df").alias("min_df")
        )
    )
    with_common = generated.join(broadcast_checked(common), by, "left").join(
        asked.select("qid", *scope, F.col("word").alias("c_word"), F.lit(1).alias("c_hit")),
        ["qid", *scope, "c_word"],
        "left",
    )
    hit = F.col("c_hit").isNotNull()
    return with_common.select(
        "qid",
        *by,
        (F.col("overlap") + F.when(hit, F.col("c_weight")).otherwise(0)).alias("overlap"),
        (F.col("n_shared") + F.when(hit, 1).otherwise(0)).alias("n_shared"),
        F.when(hit, F.least("min_df", "c_df")).otherwise(F.col("min_df")).alias("min_df"),
    )


def question_words(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(qid, _pool, words) -> (qid, _pool, word) for words the catalog's names use at all.

    Written once: texts are tokenised a single time for all tiers, and words no name uses are
    gone before anything is shuffled.
    """
    vocabulary = cut_lineage(catalog.select(POOL, F.explode(name_words("name")).alias("word")).distinct())
    asked = questions.select("qid", POOL, F.explode("words").alias("word"))
    return cut_lineage(asked.join(broadcast_checked(vocabulary), [POOL, "word"], "left_semi"))


def fuzzy_scores(asked: DataFrame, catalog: DataFrame, key: str = "name") -> DataFrame:
    """Rarity-weighted word overlap of (qid, _pool, word) with (_pool, name); ``key`` stands for the name in the result."""
    names = catalog.select(POOL, F.col(key).alias("name"), F.explode(name_words("name")).alias("word"))
    df = names.groupBy(POOL, "word").agg(F.count("*").alias("df"))
    postings = cut_lineage(
        names.join(df, [POOL, "word"]).withColumns({"weight": F.lit(1.0) / F.col("df"), "solo": F.col("df") == 1})
    )
    totals = cut_lineage(postings.groupBy(POOL, "name").agg(F.sum("weight").alias("total")))
    return _qualified(shared_words(asked, postings, [POOL]).join(broadcast_checked(totals), [POOL, "name"]))


def fuzzy(asked: DataFrame, catalog: DataFrame, min_score: float, min_margin: float) -> DataFrame:
    """The fuzzy tier: (qid, _pool, word) x (_pool, name) -> (qid, matched, confidence, tied).

    Scores have a row for each pair, so names are numbers in alphabetical order until the questions are decided.
    """
    numbers = cut_lineage(catalog.select("name").distinct().orderBy("name").withColumn("id", F.monotonically_increasing_id()))
    numbered = cut_lineage(catalog.join(broadcast_checked(numbers), "name"))
    decided = cut_lineage(decide(fuzzy_scores(asked, numbered, "id"), min_score, min_margin))
    # Undecided questions have no number; they stay out of the join, which would gather them.
    won = (
        decided.filter(F.col("matched").isNotNull()).select("qid", F.col("matched").alias("id"))
        .hint("merge").join(broadcast_checked(numbers), "id")
        .select("qid", F.col("name").alias("_matched"))
    )
    ties = (
        decided.select("qid", F.explode("tied").alias("id"))
        .hint("merge").join(broadcast_checked(numbers), "id")
        .groupBy("qid")
        .agg(F.array_sort(F.collect_set("name")).alias("_tied"))
    )
    return decided.join(won, "qid", "left").join(ties, "qid", "left").select(
        "qid",
        F.col("_matched").alias("matched"),
        "confidence",
        F.coalesce("_tied", F.array().cast("array<string>")).alias("tied"),
    )


def _tie_scores(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, name, overlap, total, n_shared, min_df) of names within the tie of their question."""
    names = hits.select("qid", "name", F.explode(name_words("name")).alias("word"))
    df = names.groupBy("qid", "word").agg(F.count("*").alias("df"))
    asked = asked.select("qid", "word", F.lit(1).alias("hit"))
    shared, weight = F.col("hit").isNotNull(), F.lit(1.0) / F.col("df")
    # Sizes before the explode say nothing about its rows, so neither side may be broadcast by them.
    return (
        names.hint("merge").join(df, ["qid", "word"])
        .hint("merge").join(asked, ["qid", "word"], "left")
        .groupBy("qid", "name")
        .agg(
            F.sum(F.when(shared, weight).otherwise(0.0)).alias("overlap"),
            F.sum(weight).alias("total"),
            F.count_if(shared).alias("n_shared"),
            F.min(F.when(shared, F.col("df"))).alias("min_df"),
        )
    )


def narrow_ties(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """Re-score each question's tied names among themselves; rarity is counted within the tie."""
    scores = _tie_scores(hits, asked)
    return decide(_qualified(scores), TIE_MIN_SCORE, TIE_MIN_MARGIN).filter(F.col("matched").isNotNull())


def _settle_hits(hits: DataFrame, asked_words: DataFrame, method: str) -> DataFrame:
    """Hits (qid, name) of one tier -> one row per question that had any."""
    grouped = hits.groupBy("qid").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))
    return _settle(grouped, hits.join(_tied(grouped), "qid", "left_semi"), asked_words, method)


def _settle_classes(hits: DataFrame, members: DataFrame, asked_words: DataFrame, method: str) -> DataFrame:
    """The same for hits (qid, _pool, class): only the classes of questions with several names are expanded to names."""
    sizes = members.groupBy(POOL, "class").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"))
    grouped = cut_lineage(
        hits.join(sizes, [POOL, "class"]).groupBy("qid").agg(F.sum("n_names").alias("n"), F.min("first_name").alias("first_name"))
    )
    several = hits.join(_tied(grouped), "qid", "left_semi").join(members, [POOL, "class"]).select("qid", "name")
    return _settle(grouped, cut_lineage(several), asked_words, method)


def _tied(grouped: DataFrame) -> DataFrame:
    return grouped.filter("n > 1").select("qid")


def _settle(grouped: DataFrame, several: DataFrame, asked_words: DataFrame, method: str) -> DataFrame:
    """``grouped`` (qid, n, first_name) of all questions with hits, ``several``: the hits (qid, name) where n > 1."""
    narrowed = narrow_ties(several, asked_words).select(
        "qid", F.col("matched").alias("narrowed"), F.col("confidence").alias("narrowed_confidence")
    )
    narrowed = cut_lineage(narrowed)
    # Names are gathered for questions that stay tied only.
    ties = several.join(narrowed, "qid", "left_anti").groupBy("qid").agg(F.array_sort(F.collect_set("name")).alias("names"))
    single = F.col("n") == 1
    won = F.col("narrowed").isNotNull()
    settled = grouped.join(narrowed, "qid", "left").join(ties, "qid", "left").select(
        "qid",
        F.when(single, F.col("first_name")).otherwise(F.col("narrowed")).alias("matched"),
        F.when(won, F.col("narrowed_confidence")).otherwise(F.lit(CONFIDENCE[method])).alias("confidence"),
        F.coalesce("names", F.array().cast("array<string>")).alias("tied"),
        F.when(won, "fuzzy").otherwise(method).alias("method"),
    )
    return cut_lineage(settled)


def exact_hits(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(qid, _pool, question) x (_pool, name): names contained in the text of their pool."""
    hits = contained_names(questions, catalog, "qid", "question", "name")
    # Sizes known of questions may be those of what they are rendered from; none is broadcast by them.
    scoped = questions.select("qid", POOL).hint("merge").join(hits, "qid")
    return scoped.join(catalog.select(POOL, "name"), [POOL, "name"], "left_semi").select("qid", "name")


def acronym_classes(catalog: DataFrame) -> DataFrame:
    """(_pool, class, name): the names of a pool by their set of acronyms, which is the class.

    Names without an acronym are in no class.
    """
    spelled = F.array_join(acronyms("name"), " ")
    return catalog.select(POOL, "name", spelled.alias("class")).filter(F.col("class") != "").distinct()


def acronym_class_hits(questions: DataFrame, members: DataFrame) -> DataFrame:
    """(qid, _pool, acronym, class): short words of a question that spell an acronym of a class.

    An acronym is listed once for each class that has it, however many names that class has.
    """
    asked = questions.select("qid", POOL, F.explode(acronym_tokens("question")).alias("acronym"))
    # A question has no acronym of more than six letters.
    listed = members.select(POOL, "class").distinct().select(POOL, "class", F.explode(F.split("class", " ")).alias("acronym"))
    listed = broadcast_checked(listed.filter(F.length("acronym") <= 6))
    return asked.hint("merge").join(listed, [POOL, "acronym"]).select("qid", POOL, "acronym", "class")


def resolve(
    questions: DataFrame,
    catalog: DataFrame,
    name: str,
    pool: str | None = None,
    min_score: float = MIN_SCORE,
    min_margin: float = MIN_MARGIN,
    words: Column | None = None,
) -> DataFrame:
    """Resolve every question (qid, question) against a catalog: exact, acronym, then fuzzy.

    ``pool`` names a column on both sides that restricts candidates. ``words`` overrides the
    question's word set (for masking). Questions without any hit keep method 'none'.
    """
    names = _with_pool(catalog, pool).select(POOL, F.col(name).alias("name"))
    if pool:  # names of pools that no question asks for can't be an answer
        names = names.join(_with_pool(questions, pool).select(POOL).distinct(), POOL, "left_semi")
    # Hits and scores are small next to the texts and feed several steps each: written once.
    names = cut_lineage(names.filter(F.col("name").isNotNull() & F.col(POOL).isNotNull()).distinct())
    asked = _with_pool(questions, pool).select(
        "qid", POOL, F.coalesce("question", F.lit("")).alias("question"),
        (words if words is not None else name_words("question")).alias("words"),
    )
    asked_words = question_words(asked, names)
    exact = _settle_hits(cut_lineage(exact_hits(asked, names)), asked_words, "exact")
    rest = asked.join(exact.select("qid"), "qid", "left_anti")
    members = cut_lineage(acronym_classes(names))
    spelled = cut_lineage(acronym_class_hits(rest, members).select("qid", POOL, "class").distinct())
    acronym = _settle_classes(spelled, members, asked_words, "acronym")
    settled = exact.select("qid").union(acronym.select("qid"))
    rest_words = cut_lineage(asked_words.join(settled, "qid", "left_anti"))
    scored = fuzzy(rest_words, names, min_score, min_margin).withColumn("method", F.lit("fuzzy"))
    found = exact.unionByName(acronym).unionByName(scored)
    return questions.select("qid").join(found, "qid", "left").select(
        "qid",
        "matched",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("tied", F.array().cast("array<string>")).alias("tied"),
        F.coalesce("method", F.lit("none")).alias("method"),
    )


def rank_categories(questions: DataFrame, categories: DataFrame, top_n: int | None = None) -> DataFrame:
    """Categories named in a question, strongest first: (qid, rank, category, overlap, frac).

    ``questions`` has (qid, question) and optionally ``mask`` ARRAY<STRING>: names whose words do
    not count as category words.
    """
    ws = name_words("question")
    if "mask" in questions.columns:
        masked = F.flatten(F.transform(F.array_compact("mask"), name_words))
        ws = without_words(ws, masked)
    asked = questions.select("qid", ws.alias("ws")).select("qid", F.size("ws").alias("n_q"), F.explode("ws").alias("word"))
    known = (
        categories.select("category", name_words("category").alias("ws"))
        .select("category", F.size("ws").alias("n_c"), F.explode("ws").alias("word"))
    )
    hits = (
        asked.join(known, "word")
        .groupBy("qid", "category", "n_q", "n_c")
        .agg(F.count("*").alias("overlap"))
        .withColumn("frac", F.col("overlap") / F.least("n_q", "n_c"))
        .filter(F.col("frac") >= 0.4)
    )
    order = Window.partitionBy("qid").orderBy(F.desc("overlap"), F.desc("frac"), "category")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    if top_n:
        ranked = ranked.filter(F.col("rank") <= top_n)
    return ranked.select("qid", "rank", "category", "overlap", "frac")


def resolve_project(questions: DataFrame, works: DataFrame, categories: DataFrame) -> DataFrame:
    """A package number decides outright; otherwise titles of the question's scope are resolved.

    ``questions``: (qid, question, scope_engineer, scope_client). The scope is the engineer when
    known, else the client, else all works. Category vocabulary does not count as title words.
    """
    # Whole-word form only, so "subpackage 3" is no package mention here.
    mention = F.when(
        F.col("question").rlike(r"(?i)\b(?:pkg|package)[-\s]*\d+\b"), F.lower(package_mention("question"))
    )
    by_package = (
        works.filter(F.col("package_no").isNotNull())
        .groupBy(F.lower("package_no").alias("pkg"))
        .agg(F.min_by("project_name", "doc_id").alias("matched"))
    )
    asked = questions.withColumn("pkg", mention)
    exact = asked.join(by_package, "pkg").select(
        "qid", "matched", F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("tied"),
        F.lit("exact").alias("method"),
    )
    # One vocabulary for all questions: the distinct words of the category list.
    vocabulary = categories.select(F.explode(name_words("category")).alias("w")).distinct()
    masked = cut_lineage(
        asked.join(exact.select("qid"), "qid", "left_anti")
        .select("qid", "scope_engineer", "scope_client", F.posexplode_outer(plain_words("question")).alias("pos", "word"))
        .withColumn("w", stem(F.lower("word")))
        .join(vocabulary.withColumn("is_category", F.lit(True)), "w", "left")
        .groupBy("qid", "scope_engineer", "scope_client")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("is_category").isNull(), F.struct("pos", "word")))),
                    lambda x: x["word"],
                ),
                " ",
            ).alias("question")
        )
        .withColumn(
            "scope",
            F.when(F.col("scope_engineer").isNotNull(), F.concat(F.lit("e:"), F.lower("scope_engineer")))
            .when(F.col("scope_client").isNotNull(), F.concat(F.lit("c:"), F.lower("scope_client")))
            .otherwise(F.lit("all")),
        )
    )
    pools = (
        works.select(
            "project_name",
            F.explode(
                F.array(
                    F.concat(F.lit("e:"), F.lower("lead_engineer")),
                    F.concat(F.lit("c:"), F.lower("client_name")),
                    F.lit("all"),
                )
            ).alias("scope"),
        )
        .filter(F.col("scope").isNotNull())
        .distinct()
    )
    scoped = resolve(masked, pools, "project_name", pool="scope")
    return exact.unionByName(scoped)


def override_client(resolved: DataFrame, works: DataFrame) -> DataFrame:
    """A resolved project settles the client when the wording left it open or contradicts it.

    ``resolved``: (qid, client, client_tied, project, project_method).
    """
    owner = works.groupBy(F.col("project_name").alias("project")).agg(
        F.min_by("client_name", "doc_id").alias("owner")
    )
    open_client = F.col("client").isNull() | (F.size("client_tied") > 0)
    contradicted = (F.col("project_method") == "exact") & ~F.col("owner").eqNullSafe(F.col("client"))
    use_owner = F.col("owner").isNotNull() & (open_client | contradicted)
    return (
        resolved.join(owner, "project", "left")
        .withColumn("client", F.when(use_owner, F.col("owner")).otherwise(F.col("client")))
        .withColumn("client_tied", F.when(use_owner, F.array().cast("array<string>")).otherwise(F.col("client_tied")))
        .drop("owner")
    )
