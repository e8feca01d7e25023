"""Operator 7: exact n-gram Jaccard join with a token-group matrix.

Every text becomes a set of hashed word shingles. Sets that are equal are one class and are joined once. The rest:

1. A fixed-size sketch counts in how many texts a shingle occurs, over all texts. It only orders the shingles, rare
   ones first; any common order gives the same result.
2. A set of ``n`` needs an overlap of ``need = ceil(t * n)`` with any partner. So two partners share at least
   ``min(SHARED, need)`` of the first ``n - need + SHARED`` shingles of each, in that order: these are the early ones.
   The same holds for any other number they share. So twice as many first shingles are shuffled (:func:`common`), and
   a set that has too few of them in common with all others together leaves; then the sets that are left are held
   against each other alone. Passages that texts repeat without being similar end here, even where the sketch is so
   full that it can't tell them from rare ones. Only the others' early shingles go on.
3. Sets that meet under a pair of min-hashes are compared with one leader exactly. What is linked so is one component;
   what has at least half in common with a leader is one group of similar sets.
4. The matrix: for each group and early shingle the largest component of its members that hold it. A set meets a group
   through the shingles they share there, if a larger component than its own holds them; pairs that share too few are
   dropped. So links inside a component are never looked for again, and of two components the smaller one asks.
5. A qualifying group is opened in pieces of up to ``PIECE`` members: the query is first held against the union of
   whole sets, and only if that bound allows, against members of larger components, until each has one link.

A group of near copies, however large, is one component after step 3, so no pairs inside it are made. Leaders of hot
min-hashes are salted. Documents (rows) that share a doc_id are one node.

Texts that are null or without words have no set and link with nothing; a null doc_id has no component. Very long
texts are hashed in pieces. Classes are told apart by 128 bits of their set and its size; shingles by 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from folioscope.llm import words as w
from folioscope.llm.common import map_pieces, pieces, row_key
from folioscope.llm.components import connected
from folioscope.session import cut_lineage, release

#: First shingles two partners have in common at least, and members of an opened piece of a group.
SHARED, PIECE = 3, 256
#: Counters of the sketch (4 bytes each, so its size is fixed) and rows it travels in.
COUNTERS, CHUNKS = 1 << 20, 64
#: Min-hashes of a set; each two consecutive ones make a band.
HASHES = 8
#: Members compared with one copy of a leader in one task.
LEADER_ROWS = 2048

_U = np.uint64


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with a partner."""
    return -(-percent * n // 100)


def common(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` and a partner no smaller share of their first ``n - need + common``; grows with ``n``."""
    need = needed(n, percent)
    return min(need, max(SHARED, n - need))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if percent * len(a) > 100 * len(b) or percent * len(b) > 100 * len(a):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _sets(piece: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for hashes in w.batches(piece.column("text").to_pylist(), fold=True):
        yield w.shingles(hashes, k)


def _sketch(source: DataFrame, k: int) -> np.ndarray:
    """Log2 of the number of texts per counter; counted in the tasks, summed in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for piece in pieces(batches, "text"):
            for s in _sets(piece, k):
                held.append((s >> _U(44)).astype(np.int32))
                size += len(s)
            if size > COUNTERS:
                total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        yield from blobs(total, TaskContext.get().partitionId() % 64)  # the same when a task is repeated

    def blobs(total: np.ndarray, group: int) -> Iterator[pa.RecordBatch]:
        parts = total.astype("<i8").reshape(CHUNKS, -1)
        yield pa.record_batch([pa.array(range(CHUNKS), pa.int32()), pa.array([group] * CHUNKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "grp", "counts"])

    schema = "chunk int, grp int, counts binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<i8")
                sums[row["chunk"]] = sums[row["chunk"]] + counts if row["chunk"] in sums else counts
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["chunk", "grp", "counts"])

    counted = source.mapInArrow(count, schema).repartition(16, "chunk", "grp").mapInArrow(add, schema).repartition(8, "chunk").mapInArrow(add, schema)
    level = np.zeros(COUNTERS, np.uint64)
    for row in counted.select("chunk", "counts").collect():  # CHUNKS rows of a fixed size
        counts = np.frombuffer(row["counts"], "<i8")
        level.reshape(CHUNKS, -1)[row["chunk"]] = np.floor(np.log2(counts + 1)).astype(np.uint64)
    return level.astype(np.uint8)


def _signatures(source: DataFrame, k: int, percent: int, level: np.ndarray) -> DataFrame:
    """(doc_id, key, n, sig1, sig2, bands, first): the set's identity, its bands, its first shingles, early ones before the others."""
    shared = source.sparkSession.sparkContext.broadcast(level)

    def task():
        level = shared.value
        odd = w.mix(np.arange(1, HASHES + 1, dtype=_U)) | _U(1)

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            n, sig1, sig2, bands, first = [], [], [], [], []
            for s in _sets(piece, k):
                n.append(len(s))
                sig1.append(int(np.sum(w.mix(s + _U(7)), dtype=_U).view(np.int64)))
                sig2.append(int(np.bitwise_xor.reduce(w.mix(s ^ _U(0x5DEECE66D))).view(np.int64)) if len(s) else 0)
                if not len(s):
                    bands.append(np.empty(0, np.int64))
                    first.append(np.empty(0, np.int64))
                    continue
                low = np.array([(s * o).min() for o in odd])
                bands.append(w.mix(low[0::2] ^ w.mix(low[1::2] + np.arange(HASHES // 2, dtype=_U))).view(np.int64))
                ordered = (level[s >> _U(44)].astype(_U) << _U(58)) | (s >> _U(6))
                slack = len(s) - needed(len(s), percent)
                early, m = min(len(s), slack + SHARED), slack + common(len(s), percent)
                first.append((np.partition(ordered, (early - 1, m - 1))[:m] if early < len(s) else ordered).view(np.int64))
            lists = [pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in y]).astype(np.int32), pa.array(np.concatenate(y) if y else np.empty(0, np.int64))) for y in (bands, first)]
            columns = [piece.column("doc_id"), piece.column("key"), pa.array(n, pa.int64()), pa.array(sig1, pa.int64()), pa.array(sig2, pa.int64()), *lists]
            return pa.record_batch(columns, ["doc_id", "key", "n", "sig1", "sig2", "bands", "first"])

        return step

    return map_pieces(source, "text", task, "doc_id long, key long, n long, sig1 long, sig2 long, bands array<long>, first array<long>")


def _attach(rows: DataFrame, source: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """``rows`` with the whole set of their doc in ``shingles``; ``keys``: (doc, key) of the text that stands for a doc.

    Sets are computed from the texts behind the join that asks for them, once a doc, and kept nowhere. The condition,
    which always holds, lets the planner filter the texts by the written docs before they are shuffled. Repeated rows
    of a text repeat its rows, which changes no result.
    """
    others = [c for c in rows.columns if c != "doc"]
    asked = rows.groupBy("doc").agg(F.collect_list(F.struct(*others)).alias("asked"))
    asked = cut_lineage(asked.join(keys.select("doc", "key"), "doc")).where("size(asked) > 0")
    texts = source.withColumnRenamed("doc_id", "doc").join(asked, ["doc", "key"]).select("doc", "asked", "text")

    def task():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            sets = pa.array([s.tobytes() for s in _sets(piece, k)], pa.binary())
            return pa.record_batch([piece.column("doc"), piece.column("asked"), sets], ["doc", "asked", "shingles"])

        return step

    found = map_pieces(texts, "text", task, f"doc long, asked {dict(asked.dtypes)['asked']}, shingles binary")
    return found.select("doc", F.explode("asked").alias("ask"), "shingles").select("ask.*", "doc", "shingles")


def _streamed(rows: DataFrame, keys: list[str], fn, names: list[str]) -> DataFrame:
    """``fn`` over each task's rows, dealt by ``keys`` and ordered by them and then by role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in batch.schema.names]
                yield from zip(*columns, strict=True)

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

        out: list[tuple] = []
        for found in fn(each()):
            out.append(found)
            if len(out) >= 5000:
                yield send()
                out = []
        if out:
            yield send()

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "role", "doc")
    return ordered.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _with_leaders(stars: DataFrame, attach: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(a, b, linked) for members and the leader they meet under a band, if they have half in common."""
    salts = stars.groupBy("leader").agg(F.ceil(F.count("*") / LEADER_ROWS).alias("salts"))
    stars = stars.join(salts, "leader")
    members = stars.select("leader", F.pmod(F.xxhash64("doc"), "salts").alias("salt"), F.lit(1).alias("role"), "doc")
    copies = salts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    leaders = copies.select("leader", "salt", F.lit(0).alias("role"), F.col("leader").alias("doc"))
    rows = attach(members.union(leaders)).select("leader", "salt", "role", "doc", "shingles")

    def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
        lead, at = np.empty(0, _U), None
        for leader, _, role, doc, shingles in rows:
            s = np.frombuffer(shingles, _U)
            if role == 0:
                lead, at = s, leader
            elif at == leader:
                both = overlap(lead, s)
                either = len(lead) + len(s) - both
                if 2 * both >= either:
                    yield doc, leader, int(100 * both >= percent * either)

    return _streamed(rows, ["leader", "salt"], compare, ["a", "b", "linked"])


def _open_groups(
    candidates: DataFrame, members: DataFrame, attach: Callable[[DataFrame], DataFrame], percent: int
) -> DataFrame:
    """Links (a, b) of queries into each qualifying group. members: (grp, doc, piece, size, component)."""
    last = members.groupBy("grp").agg(F.max("piece").alias("last"))
    own = members.select("doc", "size", "component")
    queries = candidates.join(last, "grp").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("piece"), F.lit(1).alias("role"), "doc").join(own, "doc")
    inside = members.join(candidates.select("grp").distinct(), "grp", "left_semi").select("grp", "piece", F.lit(0).alias("role"), "doc", "size", "component")
    columns = ["grp", "piece", "role", "doc", "size", "component"]
    rows = attach(queries.select(*columns).union(inside.select(*columns))).select(*columns, "shingles")

    def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, held, union = None, [], None
        for grp, piece, role, doc, size, component, shingles in rows:
            s = np.frombuffer(shingles, _U)
            if at != (grp, piece):
                at, held, union = (grp, piece), [], None
            if role == 0:
                held.append((doc, (size, component), s))
                continue
            if union is None:
                union = np.unique(np.concatenate([x for _, _, x in held])) if held else np.empty(0, _U)
            if overlap(s, union) < needed(len(s), percent):
                continue
            met = set()
            for other, rank, x in held:
                if rank > (size, component) and rank not in met and linked(s, x, percent):
                    met.add(rank)
                    yield doc, other

    return _streamed(rows, ["grp", "piece"], compare, ["a", "b"])


def _met(postings: DataFrame) -> DataFrame:
    """Postings of the shingles that several docs hold."""
    same = Window.partitionBy("token")
    met = postings.withColumn("low", F.min("doc").over(same)).withColumn("high", F.max("doc").over(same))
    return cut_lineage(met.where("low < high").drop("low", "high"))


def _wanted(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(doc, key, n) of the docs that hold as many of these postings as they share with a partner of any size."""
    least = F.ceil(F.col("n") * percent / 100)  # the smallest partner
    need = F.ceil(least * percent / 100)
    counts = met.groupBy("doc").agg(F.count("*").alias("met")).join(classes.select("doc", "key", "n"), "doc")
    return cut_lineage(counts.where(F.col("met") >= F.least(need, F.greatest(F.lit(SHARED).cast("long"), least - need))).select("doc", "key", "n"))


def join_sets(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, key, n_shingles, component_id) for every row of ``docs``; key as in :func:`row_key`."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    level = _sketch(source, words)
    whole_rows = cut_lineage(_signatures(source, words, percent, level))
    classes = whole_rows.where("n > 0 and doc_id is not null").groupBy("n", "sig1", "sig2").agg(F.min(F.struct("doc_id", "key")).alias("first_row"))
    classes = cut_lineage(classes.select("n", "sig1", "sig2", F.col("first_row.doc_id").alias("doc"), F.col("first_row.key").alias("key")))
    heads = whole_rows.join(classes.select(F.col("doc").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    early = F.col("n") - F.ceil(F.col("n") * percent / 100) + SHARED
    postings = heads.select(F.col("doc_id").alias("doc"), early.alias("early"), F.posexplode("first").alias("at", "token"))
    listed = _met(postings.select("token", "doc", (F.col("at") < F.col("early")).alias("early")))
    signed = cut_lineage(whole_rows.drop("first"))
    release(whole_rows)
    known = signed.where("n > 0 and doc_id is not null")
    of_rows = known.select("doc_id", "n", "sig1", "sig2").join(classes.withColumnRenamed("key", "_k"), ["n", "sig1", "sig2"]).select("doc_id", "doc")
    same_id = of_rows.groupBy("doc_id").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("doc_id", "low")
    shared_ids = of_rows.join(same_id, "doc_id").select(F.col("doc").alias("a"), F.col("low").alias("b"))
    least = F.least(F.lit(SHARED).cast("long"), F.ceil(F.col("n") * percent / 100))
    left = _wanted(listed, classes, percent)
    alive = _met(listed.join(left.select("doc"), "doc", "left_semi"))
    release(listed)
    wanted = _wanted(alive, classes, percent)

    asked = wanted.select(F.col("doc").alias("doc_id"), "key")
    attach = lambda rows: _attach(rows, source, wanted, words)
    banded = signed.join(asked, ["doc_id", "key"], "left_semi").select(F.col("doc_id").alias("doc"), F.posexplode("bands").alias("band", "value"))
    banded = cut_lineage(banded)
    led = banded.groupBy("band", "value").agg(F.min("doc").alias("leader"), F.count("*").alias("met")).where("met > 1")
    stars = banded.join(led, ["band", "value"]).where("doc <> leader").select("leader", "doc").distinct()
    similar = cut_lineage(_with_leaders(cut_lineage(stars), attach, percent))
    near = similar.where("linked = 1").select("a", "b")

    parts = connected(near)
    docs_in = wanted.join(parts.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    sizes = docs_in.groupBy("component").agg(F.count("*").alias("size"))
    of_group = similar.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("leader"))
    docs_in = docs_in.join(sizes, "component").join(of_group, "doc", "left")
    docs_in = cut_lineage(docs_in.select("doc", "n", "component", "size", F.coalesce("leader", "doc").alias("grp")))
    met = alive.where("early").join(docs_in, "doc").select("token", "doc", "n", "grp", F.struct("size", "component").alias("rank"))
    matrix = met.groupBy("token", "grp").agg(F.max("rank").alias("top"), F.min("rank").alias("low"))
    between = matrix.groupBy("token").agg(F.max("top").alias("t"), F.min("low").alias("l")).where("t > l").select("token")
    matrix = matrix.join(between, "token").select("token", F.col("grp").alias("to"), "top")
    shared = met.join(matrix, "token").where("top > rank").groupBy("doc", "to").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    candidates = cut_lineage(shared.where(F.col("shared") >= least).select("doc", F.col("to").alias("grp")))
    release(alive)
    pieces_of = docs_in.groupBy("grp").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    members = docs_in.join(pieces_of, "grp").select("grp", "doc", "size", "component", F.pmod(F.xxhash64("doc"), "pieces").alias("piece"))
    found = cut_lineage(_open_groups(candidates, members, attach, percent))
    release(banded, candidates, docs_in)

    whole = connected(near.union(found).union(shared_ids))
    by_class = classes.drop("key").join(whole.withColumnRenamed("node", "doc"), "doc", "left").select("n", "sig1", "sig2", F.coalesce("component", "doc").alias("component_id"))
    rows = signed.select("doc_id", "key", "n", "sig1", "sig2").join(by_class, ["n", "sig1", "sig2"], "left")
    return rows.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Of several rows with one doc_id the one with the smallest text stays; rows without an id all stay.
    """
    joined = join_sets(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(joined, docs["doc_id"] == joined["_id"], "left_anti")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return kept.withColumn("_rank", rank).where("doc_id is null or _rank = 1").select(*docs.columns)
