"""Operator 3: nearest neighbours by multiprobe p-stable hashing.

``TABLES`` hash tables; a table's key is ``hashes`` values floor((a x + b) / w) of Gaussian projections a, so near
vectors tend to share it. A query visits its own bucket and then perturbed ones (a projection's neighbour slot up or
down), in the order of the estimated success: the sum of the squared distances to the slots' borders that are crossed.
Buckets and queries meet by a join on (table, key); every bucket gives each visiting query its ``k`` nearest by exact
distance, and these are merged over buckets and tables.

The number of probes is fitted: ``AUDIT`` queries get their exact neighbours by a full scan, and the fewest probes are
taken with which ``recall`` of these lie in visited buckets; if even ``MOST_PROBES`` are too few, the tables get fewer
hash values. With none there is one bucket, and the search is exact. (Data without near neighbours needs that;
it compares every query with every vector, and the log says so.)

Queries that met fewer than ``k`` candidates, although there are more, are answered exactly: blocks of ``SHORT`` of them
pass over all rows.

Equal vectors are candidates through the first ``k + 1`` of their ids only, which is all that an answer can hold.
Buckets larger than ``PIECE`` are split and their queries sent to every part. Distances are Euclidean in double
precision on the original vectors; ties go to the smaller id. Null, zero or non-finite vectors, other lengths than the
most common and null ids take no part, as query or candidate; rows that repeat an id count once, with the first vector.
"""

from __future__ import annotations

import heapq
import logging
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioscope.llm.vectors import against_all, matrix, sample, usable
from folioscope.session import cut_lineage

log = logging.getLogger(__name__)

TABLES, MOST_PROBES, AUDIT, FIT = 4, 96, 64, 4096
BUCKET, PIECE, SHORT = 1024, 4096, 2048


class Tables:
    """Projections of all tables; width in units of a projection's spread."""

    def __init__(self, fitted: np.ndarray, hashes: int, width: float = 1.6, seed: int = 11) -> None:
        draw = np.random.default_rng(seed)
        self.hashes = hashes
        self.a = draw.standard_normal((TABLES, fitted.shape[1], hashes))
        self.width = width * float(np.std(fitted @ self.a[0])) if hashes and len(fitted) > 1 else 1.0
        self.width = self.width if self.width > 0 else 1.0
        self.b = draw.random((TABLES, hashes)) * self.width
        self.code = draw.integers(1, 1 << 62, (TABLES, max(1, hashes)), dtype=np.int64) | 1

    def slots(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and the place in them (0 to 1) of every projection."""
        at = (x @ self.a[table] + self.b[table]) / self.width
        low = np.floor(at)
        return low.astype(np.int64), at - low

    def keys(self, slots: np.ndarray, table: int) -> np.ndarray:
        return (slots * self.code[table][: self.hashes]).sum(-1, dtype=np.int64)


def probes(place: np.ndarray, most: int) -> list[tuple[int, ...]]:
    """Sets of perturbations by estimated success; perturbation i < h lowers hash i, h + i raises it."""
    h = len(place)
    score = np.r_[place, 1 - place] ** 2
    order = np.argsort(score, kind="stable")
    cost = score[order]
    out: list[tuple[int, ...]] = [()]
    heap = [(float(cost[0]), (0,))] if h else []
    while heap and len(out) < most:
        total, chosen = heapq.heappop(heap)
        moves = [int(order[i]) for i in chosen]
        if len({m % h for m in moves}) == len(moves):
            out.append(tuple(moves))
        last = chosen[-1]
        if last + 1 < 2 * h:  # shift the last one, or add the next
            heapq.heappush(heap, (total - float(cost[last]) + float(cost[last + 1]), (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + float(cost[last + 1]), (*chosen, last + 1)))
    return out


def _visited(tables: Tables, x: np.ndarray, table: int, most: int) -> list[np.ndarray]:
    """Keys of the buckets each row visits, in order."""
    slots, place = tables.slots(x, table)
    out, h = [], tables.hashes
    for s, p in zip(slots, place, strict=True):
        sets = probes(p, most)
        moves = np.zeros((len(sets), h), np.int64)
        for r, chosen in enumerate(sets):
            for m in chosen:
                moves[r, m % h] = -1 if m < h else 1
        out.append(tables.keys(s + moves, table))
    return out


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the k nearest rows to q, its own row left out."""
    rough = ((x - q) ** 2).sum(1)
    rough[ids == own] = np.inf
    if len(x) > k:
        limit = np.partition(rough, k - 1)[k - 1]
        near = np.flatnonzero(rough <= limit)
    else:
        near = np.arange(len(x))
    near = near[np.isfinite(rough[near])]
    near = near[np.lexsort((ids[near], rough[near]))][:k]
    return ids[near], np.sqrt(rough[near])


def _exact(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest vectors of each audit query, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def best(block_ids: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        at, far, vec, row_of = [], [], [], {n: i for i, n in enumerate(block_ids.tolist())}
        for i, (own, q) in enumerate(zip(*shared.value, strict=True)):
            near, distance = _nearest(block, block_ids, q, own, k)
            at.append(np.full(len(near), i))
            far.append(distance)
            vec.append(block[[row_of[n] for n in near.tolist()]])
        columns = [pa.array(np.concatenate(at)), pa.array(np.concatenate(far)), pa.array(list(np.concatenate(vec)), pa.list_(pa.float64()))]
        return pa.record_batch(columns, ["at", "far", "vector"])

    found = against_all(rows, best, "at long, far double, vector array<double>")
    rank = F.row_number().over(Window.partitionBy("at").orderBy("far"))
    got = found.withColumn("rank", rank).where(F.col("rank") <= k).collect()  # AUDIT * k rows
    return [np.array([r["vector"] for r in got if r["at"] == i]) for i in range(len(ids))]


def _fit(rows: DataFrame, queries: DataFrame, total: int, k: int, recall: float) -> tuple[Tables, int]:
    """Tables and the fewest probes that reach the wanted recall on the audit queries."""
    _, fitted = sample(rows, FIT, 3)
    ids, x = sample(queries, AUDIT, 4)
    hashes = max(2, round(math.log2(max(1, total / BUCKET)))) if total > k else 0
    true = _exact(rows, ids, x, k) if len(ids) else []
    while hashes:
        tables = Tables(fitted, hashes)
        first = []  # for each true neighbour the earliest probe over the tables
        seen = [_visited(tables, x, t, MOST_PROBES) for t in range(TABLES)]
        for i, near in enumerate(true):
            if len(near):
                ranks = np.full(len(near), MOST_PROBES)
                for t in range(TABLES):
                    at = {key: r for r, key in reversed(list(enumerate(seen[t][i].tolist())))}
                    own = tables.keys(tables.slots(near, t)[0], t)
                    ranks = np.minimum(ranks, [at.get(key, MOST_PROBES) for key in own.tolist()])
                first.append(ranks)
        if not first:
            return tables, 1
        ranks = np.sort(np.concatenate(first))
        needed = int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)])
        if needed < MOST_PROBES:
            return tables, needed + 1
        hashes -= 1
    if total > k:
        log.warning("no hash values reach the recall of %.2f: one bucket, every query is compared with all %d vectors", recall, total)
    return Tables(fitted, 0), 1


def _of_all(rows: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): from each task its k nearest of each query, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        found = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
        for batch in batches:
            if batch.num_rows:
                block_ids, block = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"))
                for i, (own, q) in enumerate(zip(ids, x, strict=True)):
                    v, d = (np.concatenate(c) for c in zip(found[i], _nearest(block, block_ids, q, own, k), strict=True))
                    first = np.lexsort((v, d))[:k]
                    found[i] = v[first], d[first]
        v, d = (np.concatenate(c) for c in zip(*found, strict=True))
        yield pa.record_batch([pa.array(np.repeat(ids, [len(f[0]) for f in found])), pa.array(v), pa.array(d)], ["query_id", "vec_id", "score"])

    return cut_lineage(rows.select("vec_id", "embedding").mapInArrow(best, "query_id long, vec_id long, score double"))


def _completed(found: DataFrame, met: DataFrame, rows: DataFrame, asked: DataFrame, least: int, k: int) -> DataFrame:
    """``found`` and exact results of the queries that ``met`` fewer than ``least`` candidates."""
    met = met.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("met"))
    short = cut_lineage(asked.join(met, "vec_id", "left").where(F.coalesce("met", F.lit(0)) < least).select("vec_id", "embedding"))
    more = short.toLocalIterator()  # at most SHORT rows are held
    while True:
        queue = list(islice(more, SHORT))
        if not queue:
            return found
        log.info("%d queries met fewer than %d candidates: all rows are compared", len(queue), least)
        found = found.union(_of_all(rows, np.array([r["vec_id"] for r in queue], np.int64), np.array([r["embedding"] for r in queue]), k))


def nearest(embeddings: DataFrame, queries, k: int = 10, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every usable row that ``queries`` (a condition) selects."""
    rows = usable(embeddings).withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    asked = rows.where(queries)
    total = rows.count()
    if not total:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    tables, most = _fit(rows, asked, total, k, recall)
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    copies = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    members = rows.withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("embedding"))
                for t in range(TABLES if tables.hashes else 1):
                    keys = tables.keys(tables.slots(x, t)[0], t)
                    yield pa.record_batch([pa.array(np.full(len(x), t)), pa.array(keys), *batch.columns], ["table", "bucket", *batch.schema.names])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                x = matrix(part.column("embedding"))
                for t in range(TABLES if tables.hashes else 1):
                    keys = _visited(tables, x, t, most)
                    row = np.repeat(np.arange(len(x)), [len(v) for v in keys])
                    yield pa.record_batch(
                        [pa.array(np.full(len(row), t)), pa.array(np.concatenate(keys)), *[c.take(pa.array(row)) for c in part.columns]], ["table", "bucket", *part.schema.names]
                    )

    schema = "table long, bucket long, vec_id long, embedding array<double>"
    placed = cut_lineage(members.mapInArrow(place, schema))
    sizes = placed.groupBy("table", "bucket").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    filled = placed.join(sizes, ["table", "bucket"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), "pieces"))
    probing = asked.mapInArrow(visit, schema).join(sizes, ["table", "bucket"])
    probing = probing.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    columns = ["table", "bucket", "piece", "role", "vec_id", "embedding"]
    both = filled.withColumn("role", F.lit(0)).select(*columns).union(probing.withColumn("role", F.lit(1)).select(*columns))

    def rank_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, x, stacked = None, [], [], None
        out: list[tuple] = []

        def send() -> pa.RecordBatch:
            q, v, d = (np.concatenate(c) for c in zip(*out, strict=True))
            out.clear()
            order = np.lexsort((v, d, q))  # of what a query found in this task's buckets, its k nearest go on
            q, v, d = q[order], v[order], d[order]
            new = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])] if len(q) else np.zeros(0, bool)
            q, v, d = q[new], v[new], d[new]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (q, v, d)], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in columns[:4]), strict=True))
            vectors, own = matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
            for i, key in enumerate(keys):
                if key[:3] != at:
                    at, ids, x, stacked = key[:3], [], [], None
                if key[3] == 0:
                    ids.append(own[i])
                    x.append(vectors[i])
                    continue
                if stacked is None:
                    stacked = np.array(ids, np.int64), np.array(x)
                if len(stacked[0]):
                    near, far = _nearest(stacked[1], stacked[0], vectors[i], own[i], k)
                    out.append((np.full(len(near), own[i]), near, far))
                if len(out) >= 20_000:
                    yield send()
        if out:
            yield send()

    ordered = both.repartition("table", "bucket", "piece").sortWithinPartitions("table", "bucket", "piece", "role")
    found = cut_lineage(ordered.mapInArrow(rank_bucket, "query_id long, vec_id long, score double"))
    met = found.select("query_id", "vec_id").distinct()
    found = _completed(found, met, rows, asked, min(k, total - 1), k)
    # At most k rows come from each task for a query and 20,000 visits.
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
