"""Operator 8: removal of long repeated word spans through minimizers of token k-mers.

The dealt method is a De Bruijn graph whose nonbranching paths are compacted by joins. This is another one: there are
no edges, degrees or compacting joins, because a list of edges has one row a word. Each window of ``window`` words is
filed under its least k-mer of ``K`` words (the leftmost of equals), which depends on the window's words alone.
Consecutive windows under the same occurrence of a k-mer form a path; its words have one hash. So there is one row for about every 16 words.

* A k-mer that lies in one document only can't be part of a repeat and goes.
* A repeated k-mer whose paths all have the same words is unambiguous: its whole path is decided at once by the
  smallest document that holds it.
* Another k-mer has several different paths. One source coordinate (document, first window) of each is looked up
  in the texts, and its windows are compared by their hashes across all paths: that decides each window exactly.

Counts per k-mer, per path and per window are aggregated before they are shuffled, so a passage that a third of the
documents share meets as one row a task. A path that a document repeats is one row with all its places, so a line that
a document repeats a thousand times joins once. Windows are compared by 64-bit hashes of their words.

Null and empty texts have no words; texts shorter than a window lose nothing. Windows are judged between different
doc_ids only, so repeated rows of one doc_id keep their words. Rows with a null doc_id keep theirs, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm import words as w
from folioscope.llm.common import map_pieces, pieces, row_key
from folioscope.session import cut_lineage, release

K = 20


def paths(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """K-mer, path hash, first window and number of windows of each path of one text."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    kmers = w.runs(hashes, k)
    width = window - k + 1
    place = _least_places(kmers, window - k + 1)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, n])
    up, down = w._tables(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    end = first + count + window - 1
    path = w.mix((total[end] - total[first]) * down[first] + end.astype(np.uint64) - first.astype(np.uint64))
    return kmers[place[first]], path, first, count


def _least_places(kmers: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of every ``width`` consecutive k-mers, the leftmost of equals."""
    low, place, span = kmers, np.arange(len(kmers)), 1
    while span < width:
        step = min(span, width - span)  # two overlapping runs of ``span`` make one of ``span + step``
        left, right = low[: len(low) - step], low[step:]
        low, place = np.minimum(left, right), np.where(right < left, place[step:], place[: len(place) - step])
        span += step
    return place


def _occurrences(docs: DataFrame, window: int, k: int) -> DataFrame:
    """A row for each path of each document, with all its first windows there."""

    def task():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            ids, tags = (np.array(piece.column(c).to_pylist(), t) for c, t in (("doc_id", np.int64), ("tag", np.int32)))
            found = [paths(hashes, window, k) for hashes in w.batches(piece.column("text").to_pylist(), fold=False)]
            kmer, path, first, count = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (list(zip(*found, strict=True)) or [()] * 4))
            doc = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            order = np.lexsort((first, path, kmer, doc))
            doc, kmer, path, first, count = (x[order] for x in (doc, kmer, path, first, count))
            new = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (kmer[1:] != kmer[:-1]) | (path[1:] != path[:-1])][: len(doc)])
            firsts = pa.ListArray.from_arrays(pa.array(np.r_[new, len(doc)].astype(np.int32)), pa.array(first.astype(np.int32)))
            columns = [pa.array(x) for x in (ids[doc[new]], tags[doc[new]], kmer[new].view(np.int64), path[new].view(np.int64))]
            return pa.record_batch([*columns, firsts, pa.array(count[new].astype(np.int32))], ["doc_id", "tag", "kmer", "path", "firsts", "count"])

        return step

    return map_pieces(docs, "text", task, "doc_id long, tag int, kmer long, path long, firsts array<int>, count int")


def _source_windows(texts: DataFrame, window: int) -> DataFrame:
    """Window hashes of the paths whose source coordinates lie in the texts: (path, offset, window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            out: list[list] = [[], [], [], []]
            for doc_id, spans, hashes in zip(piece.column("doc_id").to_pylist(), piece.column("spans").to_pylist(), w.batches(piece.column("text").to_pylist(), fold=False), strict=True):
                for s in spans:
                    if s["source"]:
                        at = hashes[s["first"] : s["first"] + s["count"] + window - 1]
                        found = w.runs(at, window).view(np.int64)
                        for held, x in zip(out, (np.full(len(found), doc_id), np.full(len(found), s["path"]), np.arange(len(found)), found), strict=True):
                            held.append(x)
            columns = [pa.array(np.concatenate(x).astype(np.int64, copy=False) if x else np.empty(0, np.int64)) for x in out]
            yield pa.record_batch(columns, ["doc_id", "path", "offset", "window"])

    return texts.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, path long, offset long, window long")


def _cover(n: int, starts: list[int], counts: list[int], window: int) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the runs of windows."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(starts, np.int64) + np.asarray(counts, np.int64) + window - 1, -1)
    return np.cumsum(edge[:n]) > 0


def _finish(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, n_words, n_removed, kept): kept words joined by one space; null kept: as it was."""

    def task():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            n_words, removed, sums, kept = [], [], [], []
            for text, starts, counts in zip(*(piece.column(c).to_pylist() for c in ("text", "starts", "counts")), strict=True):
                words, changed = (text or b"").split(), False
                n_words.append(len(words))
                if starts:
                    gone = _cover(len(words), starts, counts, window)
                    words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                    changed = True
                removed.append(n_words[-1] - len(words))
                plain = b" ".join(words)
                sums.append(hashlib.sha256(plain).hexdigest())
                kept.append(plain.decode() if changed else None)
            columns = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.string())]
            return pa.record_batch([piece.column("doc_id"), piece.column("tag"), *columns], ["doc_id", "tag", "n_words", "n_removed", "kept_sha256", "kept"])

        return step

    columns = texts.select("doc_id", "tag", "text", "starts", "counts")
    return map_pieces(columns, "text", task, "doc_id long, tag int, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, window: int = 50, k: int = K) -> DataFrame:
    """(doc_id, tag, n_words, n_removed, kept_sha256, kept) for every row of ``docs``.

    A word goes if a window over it also starts in a document with a smaller doc_id. ``kept`` holds the words left
    where some went; ``tag`` tells rows with one doc_id apart (:func:`tag`).
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag(F.col("text")).alias("tag"), F.col("text").cast("binary").alias("text"))
    found = cut_lineage(_occurrences(source.where("doc_id is not null and text is not null"), window, k))
    by_kmer = found.groupBy("kmer").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("path").alias("low"), F.max("path").alias("high")
    )
    # Written, so that the join below has two plain exchanges and a hot k-mer's rows can be split.
    repeated = cut_lineage(by_kmer.where("least < most").select("kmer", "least", (F.col("low") != F.col("high")).alias("branching")))
    met = cut_lineage(found.join(repeated, "kmer"))
    release(found, repeated)
    branching = met.where("branching")
    # Source coordinate of every path of a branching k-mer: its first place in its smallest document.
    sources = branching.groupBy("kmer", "path").agg(F.min(F.struct("doc_id", "tag", F.element_at("firsts", 1).alias("first"), "count")).alias("at"))
    sources = cut_lineage(sources.select("kmer", "path", "at.*", F.lit(True).alias("source")))
    span = lambda first, source: F.struct(first.alias("first"), "count", "path", F.lit(source).alias("source"))
    decided = met.where("not branching and doc_id > least").select("doc_id", "tag", F.transform("firsts", lambda f: span(f, False)).alias("spans"))
    looked_up = sources.select("doc_id", "tag", F.array(span(F.col("first"), True)).alias("spans"))
    spans = decided.union(looked_up).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # Documents whose branching paths have their source elsewhere are needed later, too.
    wanted = branching.select("doc_id", "tag").distinct().withColumn("open", F.lit(True))
    spans = spans.join(wanted, ["doc_id", "tag"], "full")
    texts = source.join(spans, ["doc_id", "tag"], "left")
    touched = F.col("spans").isNotNull() | F.col("open").isNotNull()
    texts = cut_lineage(_digest_untouched(texts.withColumn("touched", touched)))
    open_texts = texts.where("touched")
    windows = cut_lineage(_source_windows(open_texts.where(F.exists(F.coalesce("spans", F.array().cast(dict(texts.dtypes)["spans"])), lambda s: s["source"])), window))
    first_doc = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("window", "least")
    judged = windows.join(first_doc, "window").select("path", "offset", F.col("least"))
    own = sources.select("kmer", "path", F.col("doc_id").alias("source_doc"))
    # A path's own later copies are covered by its source; its windows also by the smallest document of any path.
    by_path = judged.groupBy("path").agg(F.collect_list(F.struct("offset", "least")).alias("judged"))
    later = branching.join(own, ["kmer", "path"]).join(by_path, "path", "left")
    run = lambda start, count: F.struct(start.cast("long").alias("start"), count.cast("long").alias("count"))
    whole = later.where("doc_id > source_doc").select("doc_id", "tag", F.transform("firsts", lambda f: run(f, F.col("count"))).alias("covered"))
    part = later.where("doc_id = source_doc").withColumn("elsewhere", F.filter("judged", lambda j: j["least"] < F.col("doc_id")))
    windows_at = F.flatten(F.transform("firsts", lambda f: F.transform("elsewhere", lambda j: run(f + j["offset"], F.lit(1)))))
    part = part.where(F.size("elsewhere") > 0).select("doc_id", "tag", windows_at.alias("covered"))
    covered = whole.union(part).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("covered")).alias("covered"))
    last = open_texts.drop("n_words", "kept_sha256").join(covered, ["doc_id", "tag"], "left")
    sure = F.filter(F.coalesce("spans", F.array().cast(dict(texts.dtypes)["spans"])), lambda s: ~s["source"])
    more = F.coalesce("covered", F.array().cast("array<struct<start:bigint,count:bigint>>"))
    last = last.select(
        "doc_id", "tag", "text",
        F.concat(F.transform(sure, lambda s: s["first"].cast("long")), F.transform(more, lambda s: s["start"])).alias("starts"),
        F.concat(F.transform(sure, lambda s: s["count"].cast("long")), F.transform(more, lambda s: s["count"])).alias("counts"),
    )
    clean = texts.where("not touched").select("doc_id", "tag", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return clean.union(_finish(last, window))


def tag(text):
    """31 bits that tell rows with one doc_id but different texts apart."""
    return row_key(text).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _digest_untouched(texts: DataFrame) -> DataFrame:
    """Texts without any repeat are finished at once and not carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts_, n_words, sums = piece.column("text").to_pylist(), [], []
            touched = piece.column("touched").to_pylist()
            for text, t in zip(texts_, touched, strict=True):
                words = [] if t else (text or b"").split()
                n_words.append(None if t else len(words))
                sums.append(None if t else hashlib.sha256(b" ".join(words)).hexdigest())
            kept = pa.array([x if t else None for x, t in zip(texts_, touched, strict=True)], pa.binary())
            yield pa.record_batch(
                [piece.column("doc_id"), piece.column("tag"), kept, piece.column("spans"), piece.column("touched"), pa.array(n_words, pa.int64()), pa.array(sums, pa.string())],
                ["doc_id", "tag", "text", "spans", "touched", "n_words", "kept_sha256"],
            )

    spans = "array<struct<first:int,count:int,path:bigint,source:boolean>>"
    columns = texts.select("doc_id", "tag", "text", F.col("spans").cast(spans).alias("spans"), "touched")
    return columns.mapInArrow(run, f"doc_id long, tag int, text binary, spans {spans}, touched boolean, n_words long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with their repeated spans cut out of the texts; texts without any stay as they are."""
    changed = remove_repeats(docs, window).where("kept is not null").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "kept").dropDuplicates(["_id", "_tag"])
    joined = docs.join(changed, docs["doc_id"].eqNullSafe(changed["_id"]) & (tag(docs["text"]) == changed["_tag"]), "left")
    text = F.coalesce("kept", docs["text"])
    out = {"text": text, "n_chars": F.when(F.col("kept").isNull(), docs["n_chars"]).otherwise(F.length("kept").cast("long"))}
    return joined.select(*[out.get(c, docs[c]).alias(c) for c in docs.columns])
