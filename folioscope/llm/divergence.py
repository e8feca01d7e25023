"""Operator 12: how far sources of one language differ in their words, audited with transducer vocabularies.

1. Terms (runs of ASCII letters and of any other character beyond ASCII, A-Z lower-cased) are counted by the documents
   of a language that hold them, each document once, with map-side combining; those of at least ``least_docs`` stay.
2. The kept terms are sorted by range partitions, and each task builds minimal acyclic transducers of at most
   ``SHARD_TERMS`` terms. Ordinals of a language's shards follow each other, so they order terms as their bytes do.
3. The texts stream through the transducers once more: every word gets its ordinal or drops out, and a task adds up
   occurrences per (lang, source, ordinal). Transducers are broadcast in rounds of at most ``ROUND_BYTES``; a larger
   vocabulary takes further rounds over the texts.
4. Shares of a group or language are whole numbers p = 1 + floor(10**9 * (n + 5) / (N + 5 V)). Pairs of sources are
   compared in blocks of ordinals and tiles of sources, and the blocks' sums are added up. Single terms are ranked
   by value and ordinal; only the terms reported are spelt out again, from the transducers.

A null text, language or source counts as ''. Every row is a document of its own, also where ids or texts repeat. A
group without kept terms has n = 0 throughout; a language without any has no rows of part ``term`` and pairs of
value 0. A source alone in its language has no pairs. No documents, no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.llm.common import pieces, slices
from folioscope.llm.transducer import LOWER, Transducer, build, words_in
from folioscope.session import cut_lineage

#: A term as UTF-8 bytes, after A-Z are lower-cased.
_TERM, _SMALL = re.compile(rb"[^\x00-\x60\x7B-\x7F]+"), LOWER.tobytes()
SCALE = 1_000_000_000
#: Terms of one transducer, bytes of transducers broadcast at once, bytes of text that walk at once.
SHARD_TERMS, ROUND_BYTES, WALK_BYTES = 1 << 17, 64 << 20, 1 << 20
#: Ordinals and sources compared in one task.
BLOCK, TILE = 1024, 128
#: Counts of terms, or of (group, ordinal), that a task holds.
HELD = 1 << 19

_SHARD = "lang string, first binary, n long, arcs binary, final binary"


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term) of the terms in at least ``least_docs`` documents of the language."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, Counter] = {}
        long_terms = 0  # bytes of terms of more than 64 bytes; the others are bounded by their number

        def rows_out() -> Iterator[pa.RecordBatch]:
            for lang, counted in met.items():
                terms, n = pa.array(counted.keys(), pa.binary()), pa.array(counted.values(), pa.int64())
                for at in range(0, len(terms), 50_000):
                    part = terms[at : at + 50_000]
                    yield pa.record_batch([pa.array([lang] * len(part)), part, n[at : at + 50_000]], ["lang", "term", "docs"])
            met.clear()

        for piece in pieces(batches, "text"):
            for lang, text in zip(*(piece.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                distinct: set[bytes] = set()
                for part in slices(text):
                    distinct.update(_TERM.findall(part.translate(_SMALL)))
                met.setdefault(lang, Counter()).update(distinct)
                long_terms += sum(len(x) for x in distinct if len(x) > 64)
            if sum(map(len, met.values())) > HELD or long_terms > 64 * HELD:
                yield from rows_out()
                long_terms = 0
        yield from rows_out()

    counted = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(task, "lang string, term binary, docs long")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    return kept.select("lang", F.col("term").cast("string").alias("term"))


def _shards(kept: DataFrame, shard_terms: int) -> DataFrame:
    """Transducers of the sorted terms, one row each."""

    def pack(lang: str, terms: list[bytes]) -> pa.RecordBatch:
        made = build(terms)
        row = (lang, terms[0], len(terms), made.arcs.astype("<i4").tobytes(), made.final.tobytes())
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["lang", "first", "n", "arcs", "final"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = None, []
        for batch in batches:
            for now, term in zip(*(batch.column(c).to_pylist() for c in ("lang", "term")), strict=True):
                if terms and (now != lang or len(terms) == shard_terms):
                    yield pack(lang, terms)
                    terms = []
                lang = now
                terms.append(term)
        if terms:
            yield pack(lang, terms)

    total = kept.count()
    ranged = kept.repartitionByRange(max(1, -(-total // shard_terms)), "lang", "term").sortWithinPartitions("lang", "term")
    return ranged.select("lang", F.col("term").cast("binary").alias("term")).mapInArrow(task, _SHARD)


def _load(row: dict | pa.StructScalar) -> Transducer:
    return Transducer(np.frombuffer(row["arcs"], "<i4").reshape(-1, 4), np.frombuffer(row["final"], bool))


def vocabulary(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The shards with ``base``, the number of the language's terms before them."""
    shards = cut_lineage(_shards(cut_lineage(kept), shard_terms))
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(shards.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))


def spelt(shards: DataFrame) -> DataFrame:
    """(lang, ord, term) of every term."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                terms = pa.array(list(_load(row).terms()), pa.binary())
                places = pa.array(np.arange(len(terms)) + row["base"])
                for at in range(0, len(terms), 10_000):
                    part = terms[at : at + 10_000]
                    yield pa.record_batch([pa.array([row["lang"]] * len(part)), places[at : at + len(part)], part], ["lang", "ord", "term"])

    return shards.mapInArrow(task, "lang string, ord long, term binary").withColumn("term", F.col("term").cast("string"))


class _Walker:
    """A language's transducers of one round."""

    def __init__(self, rows: list[dict]) -> None:
        rows = sorted(rows, key=lambda r: r["first"])
        self.parts = [(_load(r), r["base"]) for r in rows]
        self.firsts = np.array([int.from_bytes(r["first"][:8].ljust(8, b"\0"), "big") for r in rows], np.uint64)

    def ordinals(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words that are terms, and their ordinals."""
        starts, ends = words_in(text)
        out = np.full(len(starts), -1, np.int64)
        if len(self.parts) == 1:
            part, base = self.parts[0]
            found = part.ordinals(text, starts, ends)
            out = np.where(found >= 0, found + base, -1)
        elif len(starts):
            # A word's first eight bytes tell its shard, or the few whose first terms begin with the same bytes.
            head = np.zeros(len(starts), np.uint64)
            for i in range(8):
                at = np.minimum(starts + i, len(text) - 1)
                head = (head << np.uint64(8)) | np.where(starts + i < ends, text[at], 0).astype(np.uint64)
            low = np.maximum(np.searchsorted(self.firsts, head, "left") - 1, 0)
            high = np.searchsorted(self.firsts, head, "right") - 1
            for i, (part, base) in enumerate(self.parts):
                mine = np.flatnonzero((low <= i) & (i <= high))
                found = part.ordinals(text, starts[mine], ends[mine])
                out[mine[found >= 0]] = found[found >= 0] + base
        known = out >= 0
        return starts[known], out[known]


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, ordinal, n) arrays as one, with each pair of group and ordinal once."""
    group, place, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, group))
    group, place = group[order], place[order]
    first = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(place) != 0)][: len(group)])
    return group[first], place[first], np.add.reduceat(n[order], first) if len(first) else n


def _counted(docs: DataFrame, rows: list[dict]) -> DataFrame:
    """(lang, source, ord, n): a task's occurrences of the terms of ``rows``."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list[dict]] = {}
        for row in shared.value:
            by_lang.setdefault(row["lang"], []).append(row)
        walkers = {lang: _Walker(own) for lang, own in by_lang.items()}
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def rows_out(counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            names = list(groups)
            for at in range(0, len(counts[0]), 50_000):
                group, place, n = (x[at : at + 50_000] for x in counts)
                lang, source = (pa.array([name[i] for name in names]).take(pa.array(group)) for i in (0, 1))
                yield pa.record_batch([lang, source, pa.array(place), pa.array(n)], ["lang", "source", "ord", "n"])

        def walk(lang: str, own: list[tuple[int, bytes]]) -> None:
            nonlocal size
            group = np.array([g for g, _ in own], np.int64)
            at = np.cumsum([0] + [len(t) + 1 for _, t in own])
            starts, places = walkers[lang].ordinals(LOWER[np.frombuffer(b" ".join(t for _, t in own), np.uint8)])
            of = group[np.searchsorted(at, starts, "right") - 1]
            held.append(_summed([(of, places, np.ones(len(places), np.int64))]))
            size += len(held[-1][0])

        waiting: dict[str, list[tuple[int, bytes]]] = {lang: [] for lang in walkers}
        bytes_of = dict.fromkeys(walkers, 0)
        for piece in pieces(batches, "text"):
            for lang, source, text in zip(*(piece.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                if lang not in walkers:
                    continue
                group = groups.setdefault((lang, source), len(groups))
                for part in slices(text):
                    if bytes_of[lang] + len(part) > WALK_BYTES and waiting[lang]:
                        walk(lang, waiting[lang])
                        waiting[lang], bytes_of[lang] = [], 0
                    waiting[lang].append((group, part))
                    bytes_of[lang] += len(part)
            if size > HELD:
                held[:] = [_summed(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from rows_out(held.pop())
                    size = 0
        for lang, own in waiting.items():
            if own:
                walk(lang, own)
        if held:
            yield from rows_out(_summed(held))

    slim = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(task, "lang string, source string, ord long, n long")


def recount(docs: DataFrame, shards: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, ord, n): occurrences of each kept term in each group, where there are any."""
    listed = shards.select("lang", "first", (F.length("arcs") + F.length("final")).alias("size")).collect()  # one row a shard
    rounds: list[list] = []
    held = round_bytes
    for row in sorted(listed, key=lambda r: (r["lang"], bytes(r["first"]))):
        if held + row["size"] > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append((row["lang"], bytes(row["first"])))
        held += row["size"]
    parts = []
    for names in rounds:
        wanted = docs.sparkSession.createDataFrame(names, "lang string, first binary")
        rows = shards.join(F.broadcast(wanted), ["lang", "first"], "left_semi").collect()  # at most round_bytes and a shard
        plain = [{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()} for r in rows]
        parts.append(_counted(docs, plain))
    if not parts:
        return docs.sparkSession.createDataFrame([], "lang string, source string, ord long, n long")
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionAll(part)
    return counted.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)), exactly."""
    return F.expr(f"1 + (cast({n} + 5 as decimal(20, 0)) * {SCALE}bd) div cast({total} + 5 * {terms} as decimal(20, 0))")


def _exact_shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays, by long division in steps that stay below 2**63 for totals below 9 * 10**15."""
    quotient, rest = np.zeros_like(n), n + 5
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // total
        rest = rest % total
    return quotient + 1


def _compare(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums of differences of a block of ordinals, for the sources of two tiles."""
    lang, _, low, high = (x.as_py() for x in key)
    sources, tiles = rows.column("source").to_pylist(), np.array(rows.column("tile").to_pylist())
    total = np.array(rows.column("total").to_pylist(), np.int64)
    terms = np.array(rows.column("terms").to_pylist(), np.int64)
    counts = np.zeros((len(sources), rows.column("width")[0].as_py()), np.int64)
    for i, found in enumerate(rows.column("counts").to_pylist()):
        for x in found or ():
            counts[i, x["at"]] = x["n"]
    shares = _exact_shares(counts, np.maximum(total + 5 * terms, 1)[:, None])
    out: list[tuple[str, str, int]] = []
    right = np.flatnonzero(tiles == high)
    for i in np.flatnonzero(tiles == low):
        others = right[right > i] if low == high else right
        for j, value in zip(others.tolist(), np.abs(shares[others] - shares[i]).sum(axis=1).tolist(), strict=True):
            out += [(sources[i], sources[j], value), (sources[j], sources[i], value)]
    a, b, value = zip(*out, strict=True) if out else ((), (), ())
    columns = [pa.array([lang] * len(out), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())]
    return pa.table(columns, names=["lang", "source", "item", "value"])


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    placed = groups.withColumn("tile", F.floor(place / TILE).cast("int"))
    placed = placed.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("terms") - 1) / BLOCK))
    grid = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    at = F.struct((F.col("ord") % BLOCK).cast("int").alias("at"), "n")
    blocks = counts.groupBy("lang", "source", F.floor(F.col("ord") / BLOCK).alias("block")).agg(F.collect_list(at).alias("counts"))
    cells = grid.join(blocks, ["lang", "source", "block"], "left")
    # With one tile nothing is repeated; with more, a row meets each other tile once.
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    cells = cells.withColumn("width", F.greatest(F.lit(0), F.least(F.lit(BLOCK), F.col("terms") - F.col("block") * BLOCK)).cast("int"))
    cells = cells.select("lang", "block", "low", "high", "source", "tile", "total", "terms", "width", "counts")
    found = cells.groupBy("lang", "block", "low", "high").applyInArrow(_compare, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, least_docs: int = 30, top: int = 50, shard_terms: int = SHARD_TERMS, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    blank = F.lit("")
    docs = docs.select(*(F.coalesce(F.col(c), blank).alias(c) for c in ("text", "lang", "source")))
    shards = vocabulary(kept_terms(docs, least_docs), shard_terms)
    counts = cut_lineage(recount(docs, shards, round_bytes))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("terms"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = cut_lineage(groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms")))

    in_group = Window.partitionBy("lang", "source")
    pairs = pair_sums(counts, groups).withColumn("rank", F.row_number().over(in_group.orderBy(F.desc("value"), "item")))

    whole = counts.groupBy("lang", "ord").agg(F.sum("n").alias("lang_n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    terms = counts.join(whole, ["lang", "ord"]).join(groups, ["lang", "source"]).join(langs, "lang")
    terms = terms.withColumn("value", share("n", "total", "terms") - share("lang_n", "lang_total", "terms")).where("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(in_group.orderBy(F.desc("value"), "ord"))).where(F.col("rank") <= top)
    terms = terms.select("lang", "source", "ord", "value", "rank").join(spelt(shards), ["lang", "ord"])

    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = pairs.withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionAll(terms.withColumn("part", F.lit("term")).withColumnRenamed("term", "item").select(*columns))
