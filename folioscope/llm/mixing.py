"""Operator 2: mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's words are dealt to shards by a seeded hash of the doc_id and laid end to end in a seeded order there;
each shard's stream is cut into blocks of ``block`` words. The wanted number of blocks is apportioned to the
sources by highest quotients (target / 1, 3, 5, ...), and each source's quota likewise to its shards. A shard with
a quota of ``a * blocks + b`` gives its whole stream ``a`` times and once more the ``b`` blocks from a seeded block
on, around the stream's end. The documents' order is seeded, so such an arc is a random choice of documents, and
all but the two at its ends are taken whole.

A shard holds about ``shard_words`` words, so a source with a third of all rows is split over many tasks. Targets
and quotas need one row a source and one a shard.

Null text has size 0 and null sources are a source of their own, the last. Rows with equal doc_ids are separate
rows; a source without words has target 0.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from folioscope.llm.common import WORD, row_key, words_in
from folioscope.session import cut_lineage

WEIGHTS = (3, 1, 2)  # by a source's rank, repeating
SHARE, MOST = 1.5, 2.0  # words wanted of all words, and of a source's own at most


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1); the first of equals wins."""
    votes = np.asarray(votes, dtype=float)
    total, n = votes.sum(), len(votes)
    if not n or total <= 0 or seats <= 0:
        return np.zeros(n, dtype=np.int64)
    # All quotients above one bound belong to the highest ones, as long as they aren't too many.
    sure = max(0.0, seats - n / 2 - 1)
    out = np.floor(votes * (sure / total) + 0.5).astype(np.int64) if sure else np.zeros(n, dtype=np.int64)
    heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes.tolist(), out.tolist(), strict=True)) if v > 0]
    heapq.heapify(heap)
    for _ in range(int(seats - out.sum())):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * int(out[i]) + 1), i))
    return out


def _sources(slim: DataFrame) -> DataFrame:
    """One row a source: source_size and target. The cap's fixed point in one pass over size / weight."""
    by = slim.groupBy("source", "named").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("named").desc(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    # In order of cap / weight, a source is capped if the level shared among it and all later ones lies above its own.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("named").desc(), "source")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    by = by.withColumn("level", level)
    # The first source that the level leaves below its cap gives the level of all that follow.
    open_at = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))
    by = by.withColumn("level", F.min(open_at).over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return by.select("source", "named", "source_size", target.alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("text_key"), F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNotNull().alias("named"), words_in(F.col("text")).alias("size"),
    )


def apportion(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, whole, part, part_at, taken) for every row.

    ``whole``: times the document is taken as a whole; ``part``: words of it taken once more, from word ``part_at``
    on, around its end.
    """
    return _apportion(cut_lineage(_sized(docs)), **options)


def _apportion(slim: DataFrame, block: int = 8, shard_words: int = 4_000_000, seed: int = 29) -> DataFrame:
    sources = cut_lineage(_sources(slim))
    words = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    seats = round(words / block)

    def source_quota(all_rows: pd.DataFrame) -> pd.DataFrame:
        all_rows = all_rows.sort_values(["named", "source"], ascending=[False, True])
        return all_rows[["source", "named"]].assign(quota=sainte_lague(all_rows["target"].to_numpy(), seats))

    # One row a source in this one group.
    quotas = sources.groupBy().applyInPandas(source_quota, "source string, named boolean, quota long")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    sources = cut_lineage(sources.join(quotas, ["source", "named"]).withColumn("shards", shards))
    dealt = slim.join(sources, ["source", "named"]).withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
    dealt = cut_lineage(dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("shards"))))

    def shard_quota(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        return rows[["source", "named", "shard", "words"]].assign(quota=sainte_lague(rows["words"].to_numpy(), int(rows["quota"].iloc[0])))

    # One row a shard; a source's shards are in one group.
    by_shard = dealt.groupBy("source", "named", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    by_shard = by_shard.groupBy("source", "named").applyInPandas(shard_quota, "source string, named boolean, shard long, words long, quota long")
    blocks = F.ceil(F.col("words") / block)
    by_shard = cut_lineage(
        by_shard.where("words > 0").select(
            "source", "named", "shard", blocks.alias("blocks"), F.floor(F.col("quota") / blocks).alias("rounds"), (F.col("quota") % blocks).alias("more"),
            F.pmod(F.xxhash64(F.lit(seed + 2), "source", "named", "shard"), blocks).alias("first"),
        )
    )
    placed = dealt.drop("quota").join(by_shard, ["source", "named", "shard"], "left")
    upto = Window.partitionBy("source", "named", "shard").orderBy("order", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(upto)).withColumn("start", F.col("end") - F.col("size"))
    lo, hi = F.col("first") * block, (F.col("first") + F.col("more")) * block
    over = hi - F.col("blocks") * block  # words of the arc that lie beyond the stream's end

    def taken_before(x):
        straight = F.greatest(F.lit(0), F.least(x, hi) - lo)
        return straight + F.least(x, F.greatest(F.lit(0), over))

    # Where a document holds the arc's end and its start again, its part runs around its end.
    part_at = F.when((over > F.col("start")) & (lo < F.col("end")) | (over <= F.col("start")), F.greatest(F.lit(0), lo - F.col("start"))).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    return placed.select(
        "doc_id", "text_key", F.when(F.col("named"), F.col("source")).alias("source"), "size", "source_size", "target",
        F.coalesce("rounds", zero).cast("long").alias("whole"),
        F.coalesce(taken_before(F.col("end")) - taken_before(F.col("start")), zero).cast("long").alias("part"),
        F.coalesce(part_at, zero).cast("long").alias("part_at"),
    ).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each time a document is taken.

    Rows that repeat a doc_id with the same text count as one document.
    """
    columns, keyed = docs.columns, docs.withColumn("_text_key", row_key(F.col("text")))
    rows = cut_lineage(_sized(docs))
    slim = rows.groupBy("doc_id", "text_key").agg(F.min(F.struct("named", "source")).alias("of"), F.min("size").alias("size"), F.count("*").alias("rows"))
    slim = cut_lineage(slim.select("doc_id", "text_key", "of.source", "of.named", "size", "rows"))
    if not slim.where("rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", "_text_key"])
    taken = _apportion(slim.drop("rows"), **options).where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("size").alias("_size"), F.col("whole").alias("_whole"), F.col("part").alias("_part"), F.col("part_at").alias("_at")
    )
    joined = keyed.join(taken, keyed["doc_id"].eqNullSafe(taken["_id"]) & (F.col("_text_key") == F.col("_key")))
    parts = F.when(F.col("_part") > 0, F.array("_part")).otherwise(F.array().cast("array<long>"))
    rows = joined.withColumn("_take", F.explode(F.concat(F.expr("array_repeat(_size, cast(_whole as int))"), parts)))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    at, end = F.col("_at"), F.col("_at") + F.col("_take")
    cut = F.concat(F.slice(words, (at + 1).cast("int"), F.col("_take").cast("int")), F.slice(words, F.lit(1), F.greatest(F.lit(0), end - F.col("_size")).cast("int")))
    text = F.when(F.col("_take") == F.col("_size"), F.col("text")).otherwise(F.array_join(cut, " "))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*columns)
