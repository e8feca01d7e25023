"""Which catalog names occur inside which texts, as equi-joins instead of a theta join.

Every name gets one *anchor* that any text containing it must also have; texts are joined on
the anchor and only those candidates are verified. Names with three or more words use their
rarest inner word: it is delimited on both sides, so it is a whole word of the text too. Shorter
names may start or end inside a word of the text: two words use the characters around what
separates them, which a text has once per word, and single words use a run of characters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.operators.lookup import broadcast_checked
from folioscope.session import cut_lineage

# Run lengths tried for short names, longest first.
GRAM_SIZES = (16, 8, 4, 2, 1)
# Single tokens are short, so finer steps cost little there and leave few false candidates.
TOKEN_GRAM_SIZES = (12, 8, 6, 5, 4, 3, 2, 1)
WORD = "[\\p{L}\\p{N}]+"
# Kinds of anchor with few names cost a pass over all texts each; up to so many names of up to so many characters are tried as they are instead.
LITERAL_NAMES, LITERAL_CHARACTERS = 64, 64
# Characters before and after the separator of two words, longest first.
END_SIZES = (4, 2, 1)
START_SIZES = (16, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1)
# A seam of m and n characters is kind -(100 m + n); kind 0 is a word, others are run lengths.
SEAMS = {-(100 * m + n): (m, n) for m in END_SIZES for n in START_SIZES}


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _runs(text: Column, size: int) -> Column:
    """All overlapping runs of ``size`` characters, in one linear regex pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _seams(text: Column, kind: int) -> Column:
    """The last characters of a word, what follows up to the next word, and the first characters of that."""
    m, n = SEAMS[kind]
    letter = "[\\p{L}\\p{N}]"
    return F.regexp_extract_all(text, F.lit(f"(?=({letter}{{{m}}}[^\\p{{L}}\\p{{N}}]+{letter}{{{n}}}))"), F.lit(1))


def _found(text: Column, kind: int) -> Column:
    """All anchors of one kind in a text."""
    if kind == 0:
        return _tokens(text)
    return _runs(text, kind) if kind > 0 else _seams(text, kind)


def _largest(length: Column, sizes: tuple[int, ...]) -> Column:
    return reduce(lambda acc, n: F.when(length >= n, F.lit(n)).otherwise(acc), reversed(sizes), F.lit(None))


def _rarest(options: DataFrame) -> DataFrame:
    """(name, kind, anchor) options -> one anchor per name: fewest names share it, then longest."""
    shared = options.groupBy("kind", "anchor").agg(F.count("*").alias("df"))
    return (
        options.join(shared, ["kind", "anchor"])
        .groupBy("name")
        .agg(F.min_by(F.struct("kind", "anchor"), F.struct("df", -F.length("anchor"), "anchor")).alias("a"))
        .select("name", "a.kind", "a.anchor")
    )


def _name_options(names: DataFrame, whole_words: bool, sizes: tuple[int, ...]) -> DataFrame:
    """Every possible anchor of every distinct name: (name, kind, anchor). kind 0 = word, n = run, below 0 = seam."""
    named = names.filter(F.length("name") > 0).withColumn("_low", F.lower("name")).withColumn("_ws", _tokens(F.col("_low")))
    low, tokens, n_tokens = F.col("_low"), F.col("_ws"), F.size("_ws")
    by_word, inner = n_tokens > 0, tokens
    two_words = F.lit(False)
    if not whole_words:
        by_word, inner = n_tokens >= 3, F.slice(tokens, 2, F.greatest(n_tokens - 2, F.lit(0)))
        two_words = n_tokens == 2
    first, second = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(2))
    m, n = _largest(F.length(first), END_SIZES), _largest(F.length(second), START_SIZES)
    between = F.regexp_extract(low, f"{WORD}([^\\p{{L}}\\p{{N}}]+){WORD}", 1)
    seam = F.concat(F.right(first, m), between, F.left(second, n))
    kinded = named.withColumn("kind", F.when(by_word, 0).when(two_words, -(100 * m + n)).otherwise(_largest(F.length(low), sizes)))
    kind = F.col("kind")
    anchors = reduce(
        lambda acc, size: F.when(kind == size, _runs(low, size)).otherwise(acc),
        sizes,
        F.when(kind == 0, inner).when(kind < 0, F.array(seam)),
    )
    return kinded.select("name", "kind", F.explode(F.array_distinct(anchors)).alias("anchor"))


def _text_anchors(texts: DataFrame, text_id: str, text: str, kinds: list[int]) -> DataFrame:
    """(text_id, kind, anchor) for the kinds of anchor the catalog really uses; each kind has tasks of its own."""
    low = F.lower(text)
    parts = []
    for kind in kinds:
        found = F.explode(F.array_distinct(_found(low, kind)))
        parts.append(texts.select(text_id, F.lit(kind).alias("kind"), found.alias("anchor")))
    return reduce(DataFrame.unionByName, parts)


def contained_names(
    texts: DataFrame,
    names: DataFrame,
    text_id: str,
    text: str,
    name: str,
    whole_words: bool = False,
    sizes: tuple[int, ...] = GRAM_SIZES,
    literal: bool = False,
) -> DataFrame:
    """Distinct (text_id, name) pairs where the text contains the name, ignoring case.

    ``whole_words`` demands a word boundary on both sides. The text column itself is not carried
    through the explode; it is joined back by id for the candidates only. ``literal`` lets the texts be tried
    on the names of rare kinds one by one; how often a pair of a repeated text_id comes then depends on its kind.
    """
    wanted = names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct()
    anchors = cut_lineage(_rarest(_name_options(wanted, whole_words, sizes)))
    # A few dozen values at most: decides which kinds of anchor the texts have to produce.
    counts = anchors.groupBy("kind").agg(F.count("*").alias("n"), F.max(F.length("name")).alias("longest")).collect()
    rare = _rare_kinds({r["kind"]: r["n"] for r in counts if literal and r["longest"] <= LITERAL_CHARACTERS})
    kinds = sorted(r["kind"] for r in counts if r["kind"] not in rare)
    parts = []
    if rare:
        few = anchors.filter(F.col("kind").isin(rare)).select("name", F.lower("name").alias("low")).collect()
        parts.append(_literal_hits(texts, few, text_id, text, name, whole_words))
    if kinds:
        parts.append(_anchored_hits(texts, anchors, kinds, text_id, text, name, whole_words))
    if not parts:
        return texts.select(text_id, F.lit(None).cast("string").alias(name)).filter(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def _rare_kinds(counts: dict[int, int]) -> list[int]:
    """The kinds with the fewest names, LITERAL_NAMES in all at most."""
    chosen, n = [], 0
    for kind in sorted(counts, key=lambda k: (counts[k], k)):
        n += counts[kind]
        if n > LITERAL_NAMES:
            break
        chosen.append(kind)
    return chosen


def _holds(low: Column, needle: Column, whole_words: bool) -> Column:
    found = F.contains(low, needle)
    if whole_words:
        found = found & F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), needle, F.lit(r"\E\b")))
    return found


def _literal_hits(texts: DataFrame, few: list, text_id: str, text: str, name: str, whole_words: bool) -> DataFrame:
    """Names tried one by one on every text, all in one pass without a join."""
    tried = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["low"]).alias("low")) for r in few])
    held = F.filter(tried, lambda x: _holds(F.col("_low"), x["low"], whole_words))
    return (
        texts.select(text_id, F.lower(text).alias("_low"))
        .select(text_id, F.explode(held).alias("_x"))
        .select(text_id, F.col("_x.name").alias(name))
    )


def _anchored_hits(
    texts: DataFrame, anchors: DataFrame, kinds: list[int], text_id: str, text: str, name: str, whole_words: bool
) -> DataFrame:
    """Names found through their anchors, then verified."""
    anchors = anchors.filter(F.col("kind").isin(kinds))
    # Written, so that the texts are shuffled for verification only when the candidates are many. The planner may know
    # only the size of what the texts are built from, so they are never broadcast by it.
    candidates = cut_lineage(
        _text_anchors(texts, text_id, text, kinds)
        .hint("merge").join(broadcast_checked(anchors), ["kind", "anchor"])
        .select(text_id, "name")
    )
    return (
        texts.select(text_id, text)
        .hint("merge").join(broadcast_checked(candidates), text_id)
        .filter(_holds(F.lower(text), F.lower("name"), whole_words))
        .select(text_id, F.col("name").alias(name))
    )



def contained_words(texts: DataFrame, words: DataFrame, text_id: str, text: str, word: str) -> DataFrame:
    """Like :func:`contained_names` for names without blanks, such as single words.

    A word without blanks lies inside one blank-separated token, so the search runs over the
    distinct tokens of all texts, a vocabulary far smaller than the texts, and is joined back.
    """
    tokens = texts.select(text_id, F.explode(F.array_distinct(F.split(F.lower(text), r"\s+"))).alias("_token"))
    vocabulary = cut_lineage(tokens.select("_token").distinct().withColumn("_body", F.col("_token")))
    # A catalog far larger than the texts' vocabulary loses most of its words before anchors are chosen for them.
    possible = cut_lineage(_beginning_in(vocabulary, words, word))
    hits = cut_lineage(contained_names(vocabulary, possible, "_token", "_body", word, sizes=TOKEN_GRAM_SIZES))
    return tokens.hint("merge").join(broadcast_checked(hits), "_token").select(text_id, word).distinct()


def _beginning_in(vocabulary: DataFrame, words: DataFrame, word: str) -> DataFrame:
    """The words whose first characters some token has; the others can't lie inside one."""
    runs = cut_lineage(_text_anchors(vocabulary, "_token", "_body", sorted(TOKEN_GRAM_SIZES)).select("kind", "anchor").distinct())
    low = F.lower("name")
    kinded = words.select(F.col(word).alias("name")).withColumn("kind", _largest(F.length(low), TOKEN_GRAM_SIZES))
    starts = kinded.withColumn("anchor", F.left(low, F.col("kind"))).distinct()
    return starts.join(broadcast_checked(runs), ["kind", "anchor"], "left_semi").select(F.col("name").alias(word))
