"""Operator 1: near-duplicate vectors through a robust-pruned flat graph.

1. Equal vectors are one node with a multiplicity.
2. Nodes go to the ``overlap`` nearest of at most ``CENTROIDS`` centroids (fitted on a bounded sample): overlapping
   cluster shards. A shard is cut into pieces of about ``PIECE`` nodes by a hash, so a dense cluster has many.
3. In each piece a flat graph is built: nearest candidates, robustly pruned (a neighbour goes if a kept one is nearer
   to it by the factor ``ALPHA``), the edges' reverses and a few random nodes for the long way. A node's lists from
   all its shards are united.
4. For each two pieces of a shard (and each piece with itself) one task searches: greedily with a beam from the
   medoids, then it expands in range from all that it has found, over the united lists. Every hit is verified by its
   cosine in double precision. Hits are counted, never sent on: of a task come each node's number of links and its
   root in the task's own forest. A pair that meets in several shards counts in the first.
5. Recall is audited: ``AUDIT`` nodes are compared with all others. Each audited node with a link counts alike, however
   many it has, and equal copies don't count; the nodes are parted by their number of links (1, 2 to 3, 4 to 7, ...), and
   while a part found less than ``recall`` of its links on average, the shards overlap more.
6. If ``MOST_OVERLAP`` shards a node are still too few, all links are counted exactly: nodes are cut into blocks by their
   nearest centroid, and two blocks meet with those of their nodes that can have a link there by the triangle inequality
   of angles (distance to the other centroid at most its radius plus the angle of ``least``). Data that is spread so far
   that no bound helps takes (nodes / BLOCK)**2 / 2 bounded tasks.

The audit is a sample: where none of its nodes has a link, links are rare (below 1 % of the nodes) and steps 1 to 4 stand.

Near copies that are no equal vectors are counted pair by pair inside the tasks, so a dense group of g vectors takes
(g / PIECE)**2 / 2 tasks; each is bounded, and none emits more than its rows.

Null, zero and non-finite vectors and such of another length than the most common link with nothing; rows with the
same id count as separate vectors but share a row of results (the first by id); a null id links with nothing.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.components import connected
from folioscope.llm.vectors import against_all, matrix, sample, usable
from folioscope.session import cut_lineage

log = logging.getLogger(__name__)

CENTROIDS, SHARD, PIECE, SAMPLE = 1024, 1024, 2048, 16_384
NEAR, REVERSE, RANDOM = 16, 16, 8  # neighbours in a list by kind
DEGREE, CANDIDATES, ALPHA, BEAM, MEDOIDS = NEAR + REVERSE + RANDOM, 64, 1.2, 24, 16
AUDIT, MOST_OVERLAP = 512, 5
BLOCK, STEP = 8192, 256  # nodes of a block and of a step in it, where all links are counted


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on unit vectors, from evenly taken rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def _pruned(x: np.ndarray) -> np.ndarray:
    """Up to NEAR robustly pruned neighbours of each unit vector, -1 where there are fewer."""
    m = len(x)
    width = min(CANDIDATES, m - 1)
    out = np.full((m, NEAR), -1, np.int64)
    if width < 1:
        return out
    far = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    np.fill_diagonal(far, np.inf)
    near = np.argpartition(far, width - 1, axis=1)[:, :width]
    order = np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    own, alive, row = np.take_along_axis(far, near, 1), np.ones((m, width), bool), np.arange(m)
    for d in range(NEAR):
        first = alive.argmax(1)
        some = alive[row, first]
        if not some.any():
            break
        pick = near[row, first]
        out[some, d] = pick[some]
        covered = ALPHA * far[pick[:, None], near] <= own
        covered[row, first] = True
        alive &= ~covered | ~some[:, None]
    return out


def build(x: np.ndarray) -> np.ndarray:
    """DEGREE neighbours of each unit vector, -1 where there are fewer: pruned, reverse and random edges."""
    m, near = len(x), _pruned(x)
    out = np.full((m, DEGREE), -1, np.int64)
    out[:, :NEAR] = near
    source, slot = np.nonzero(near >= 0)
    target = near[source, slot]
    order = np.lexsort((source, slot, target))  # a node's nearest followers first
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    keep = rank < REVERSE
    out[target[keep], NEAR + rank[keep]] = source[keep]
    if m > 1:
        out[:, NEAR + REVERSE :] = np.random.default_rng(m).integers(0, m, (m, RANDOM))
    return out


def _similar(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, in bounded steps."""
    out = np.empty(len(a))
    for at in range(0, len(a), 50_000):
        s = slice(at, at + 50_000)
        out[s] = np.einsum("ij,ij->i", x[a[s]], y[b[s]])
    return out


def search(queries: np.ndarray, nodes: np.ndarray, lists: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with a cosine of ``least`` or more that the graph leads to."""
    nq, m = len(queries), len(nodes)
    medoids = np.unique(np.argmax(nodes @ centroids(nodes, min(MEDOIDS, m), 3).T, axis=0))
    seen = np.zeros((nq, m), bool)
    seen[:, medoids] = True
    beam, close, done = np.full((nq, BEAM), -1), np.full((nq, BEAM), -np.inf), np.ones((nq, BEAM), bool)
    beam[:, : len(medoids)], close[:, : len(medoids)], done[:, : len(medoids)] = medoids, queries @ nodes[medoids].T, False
    slack = least - 0.05
    first = np.argwhere(close[:, : len(medoids)] >= slack)
    met = [(first[:, 0], medoids[first[:, 1]], close[first[:, 0], first[:, 1]])]
    active = np.arange(nq)
    while len(active):
        value = np.where(done[active], -np.inf, close[active])
        best = value.argmax(1)
        go = value[np.arange(len(active)), best] > -np.inf
        active, best = active[go], best[go]
        if not len(active):
            break
        done[active, best] = True
        near = lists[beam[active, best]]
        q, n = np.repeat(active, near.shape[1]), near.ravel()
        fresh = (n >= 0) & ~seen[q, np.maximum(n, 0)]
        value = np.full(near.size, -np.inf)
        value[fresh] = _similar(queries, q[fresh], nodes, n[fresh])
        seen[q[fresh], n[fresh]] = True
        reached = value >= slack
        met.append((q[reached], n[reached], value[reached]))
        value = value.reshape(near.shape)
        all_close = np.c_[close[active], value]
        top = np.argpartition(-all_close, BEAM - 1, axis=1)[:, :BEAM]
        beam[active] = np.take_along_axis(np.c_[beam[active], near], top, 1)
        done[active] = np.take_along_axis(np.c_[done[active], ~np.isfinite(value)], top, 1)
        close[active] = np.take_along_axis(all_close, top, 1)
    # Range: from everything near enough that was met, through all neighbours.
    q, n, value = (np.concatenate(x) for x in zip(*met, strict=True))
    _, once = np.unique(q * m + n, return_index=True)
    q, n, value = q[once], n[once], value[once]
    hits = [(q[value >= least], n[value >= least])]
    while len(q):
        near = lists[n]
        q, n = np.repeat(q, near.shape[1]), near.ravel()
        fresh = (n >= 0) & ~seen[q, np.maximum(n, 0)]
        flat = np.unique(q[fresh] * m + n[fresh])
        q, n = flat // m, flat % m
        seen[q, n] = True
        value = _similar(queries, q, nodes, n)
        hits.append((q[value >= least], n[value >= least]))
        q, n = q[value >= slack], n[value >= slack]
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each connected part."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _shards(nodes: DataFrame, centers: np.ndarray, overlap: int) -> DataFrame:
    """(shard, piece, pieces, vec_id, weight, shards, embedding): a row for every shard of a node."""
    shared = nodes.sparkSession.sparkContext.broadcast(centers)

    def run(batches):
        for batch in batches:
            x = unit(matrix(batch.column("embedding"))) if batch.num_rows else np.empty((0, shared.value.shape[1]))
            k = min(overlap, len(shared.value))
            near = np.sort(np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :k], axis=1)
            yield pa.record_batch([*batch.columns, pa.array(list(near), pa.list_(pa.int64()))], [*batch.schema.names, "shards"])

    rows = nodes.mapInArrow(run, "vec_id long, weight long, embedding array<float>, shards array<long>")
    rows = cut_lineage(rows.withColumn("shard", F.explode("shards")))
    # One row a shard, at most CENTROIDS.
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    return rows.join(F.broadcast(sizes), "shard").withColumn("piece", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int"))


def _lists(rows: DataFrame) -> DataFrame:
    """(vec_id, near): neighbours of each node, united over its shards."""

    def one(table: pa.Table) -> pa.Table:
        ids, near = table.column("vec_id").to_numpy(), build(unit(matrix(table.column("embedding"))))
        return pa.table({"vec_id": ids, "near": pa.array([ids[r[r >= 0]] for r in near], pa.list_(pa.int64()))})

    built = rows.select("shard", "piece", "vec_id", "embedding").groupBy("shard", "piece").applyInArrow(one, "vec_id long, near array<long>")
    # At most DEGREE neighbours from each of its shards.
    return built.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


_FOUND = "vec_id long, links long, met long, root long"


def _searched(rows: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """(vec_id, links, met, root) from each task a node takes part in; met counts nodes, links rows."""
    rows = rows.join(lists, "vec_id", "left").select("shard", "piece", "pieces", "vec_id", "weight", "shards", "embedding", "near")
    # A piece's graph is searched by itself and by every piece before it.
    ends = F.sequence(F.lit(0), F.col("piece"))
    graphs = rows.select("shard", F.explode(ends).alias("i"), F.col("piece").alias("j"), F.lit(0).alias("role"), "vec_id", "weight", "shards", "embedding", "near")
    later = F.when(F.col("piece") + 1 < F.col("pieces"), F.sequence(F.col("piece") + 1, F.col("pieces") - 1)).otherwise(F.array().cast("array<int>"))
    queries = rows.select("shard", F.col("piece").alias("i"), F.explode(later).alias("j"), F.lit(1).alias("role"), "vec_id", "weight", "shards", "embedding", F.lit(None).cast("array<long>").alias("near"))

    def one(table: pa.Table) -> pa.Table:
        shard, role = table.column("shard")[0].as_py(), table.column("role").to_numpy()
        ids, weight, x = table.column("vec_id").to_numpy(), table.column("weight").to_numpy(), unit(matrix(table.column("embedding")))
        shards = matrix(table.column("shards")).astype(np.int64)
        graph, asked = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        none = pa.table({c: pa.array([], pa.int64()) for c in ("vec_id", "links", "met", "root")})
        if not len(graph):
            return none
        alone = not len(asked)
        asked = graph if alone else asked
        by_id = np.argsort(ids[graph])
        sorted_ids, lists = ids[graph][by_id], np.full((len(graph), DEGREE * shards.shape[1]), -1, np.int64)
        for r, near in enumerate(table.column("near").filter(pa.array(role == 0)).to_pylist()):
            at = np.searchsorted(sorted_ids, near or [])
            at = np.minimum(at, len(sorted_ids) - 1)
            found = by_id[at[sorted_ids[at] == np.array(near or [], np.int64)]]
            lists[r, : len(found)] = found
        q, n = search(x[asked], x[graph], lists, least)
        q, n = asked[q], graph[n]
        if alone:  # what one finds, the other has found, too
            size = len(ids)
            flat = np.unique(np.r_[q * size + n, n * size + q])
            q, n = flat // size, flat % size
        else:
            q, n = np.r_[q, n], np.r_[n, q]
        keep = q != n
        q, n = q[keep], n[keep]
        both = np.where((shards[q][:, :, None] == shards[n][:, None, :]).any(2), shards[q], np.iinfo(np.int64).max).min(1)
        mine = both == shard
        q, n = q[mine], n[mine]
        links = np.bincount(q, weights=weight[n], minlength=len(ids)).astype(np.int64)
        root, met = _roots(len(ids), q, n), np.flatnonzero(links)
        return pa.table({"vec_id": ids[met], "links": links[met], "met": np.bincount(q, minlength=len(ids))[met], "root": ids[root[met]]})

    return graphs.union(queries).groupBy("shard", "i", "j").applyInArrow(one, _FOUND)


def _every_link(nodes: DataFrame, centers: np.ndarray, least: float) -> DataFrame:
    """What ``_searched`` gives, of all links: every two blocks meet with the nodes that may have a link there."""
    spark = nodes.sparkSession
    fixed = spark.sparkContext.broadcast(centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12))

    def angles(x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ to.T, -1, 1))

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                far = angles(unit(matrix(batch.column("embedding"))), fixed.value)
                cell = far.argmin(1)
                yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(far[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "far"])

    placed = cut_lineage(nodes.mapInArrow(home, "vec_id long, weight long, embedding array<float>, cell long, far double"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # at most CENTROIDS rows
    reach, blocks = np.full(len(centers), -1.0), np.zeros(len(centers), np.int64)
    for r in sizes:
        reach[r["cell"]], blocks[r["cell"]] = r["far"] + math.acos(least) + 1e-6, -(-r["n"] // BLOCK)
    shared = spark.sparkContext.broadcast((reach, blocks, np.cumsum(blocks) - blocks))

    def spread(batches):
        reach, blocks, start = shared.value
        owner = np.repeat(np.arange(len(blocks)), blocks)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, cell = part.column("vec_id").to_numpy(), part.column("cell").to_numpy()
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = start[cell] + mixed.astype(np.int64) % blocks[cell]
                may = angles(unit(matrix(part.column("embedding"))), fixed.value) <= reach
                row, other = np.nonzero(may[:, owner])
                for k in range(0, len(row), 4000):
                    r, o = row[k : k + 4000], other[k : k + 4000]
                    mine = own[r]
                    columns = [pa.array(np.minimum(mine, o)), pa.array(np.maximum(mine, o)), pa.array(mine), *(part.column(c).take(pa.array(r)) for c in ("vec_id", "weight", "embedding"))]
                    yield pa.record_batch(columns, ["i", "j", "block", "vec_id", "weight", "embedding"])

    def one(table: pa.Table) -> pa.Table:
        block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, weight = table.column("vec_id").to_numpy(), table.column("weight").to_numpy()
        x, size = unit(matrix(table.column("embedding"))), len(ids)
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, met, root = np.zeros(size, np.int64), np.zeros(size, np.int64), np.arange(size)
        for at in range(0, len(a), STEP):
            q = a[at : at + STEP]
            near = x[q] @ x[b].T >= least
            if i == j:
                near[np.arange(len(q)), np.arange(at, at + len(q))] = False
            links[q] += near @ weight[b]
            met[q] += near.sum(1)
            if i != j:
                links[b] += weight[q] @ near
                met[b] += near.sum(0)
            s, t = np.nonzero(near)
            if len(s):
                root = _roots(size, np.r_[np.arange(size), q[s]], np.r_[root, b[t]])
        some = np.flatnonzero(met)
        return pa.table({"vec_id": ids[some], "links": links[some], "met": met[some], "root": ids[root[some]]})

    rows = placed.mapInArrow(spread, "i long, j long, block long, vec_id long, weight long, embedding array<float>")
    return rows.groupBy("i", "j").applyInArrow(one, _FOUND)


def _true_links(rows: DataFrame, ids: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """Number of other nodes linked with each audit node, over all nodes."""
    shared = rows.sparkSession.sparkContext.broadcast(unit(x))

    def count(_: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        n = ((shared.value @ unit(block).T) >= least).sum(1)
        return pa.record_batch([pa.array(np.arange(len(n))), pa.array(n.astype(np.int64))], ["at", "n"])

    got = against_all(rows, count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # AUDIT rows
    out = np.zeros(len(ids), np.int64)
    for r in got:
        out[r["at"]] = r["n"] - 1
    return out


def _worst(found: np.ndarray, truth: np.ndarray) -> float:
    """Least mean recall of the audit nodes' parts with 1, 2 to 3, 4 to 7, ... links; 1 where no node has one."""
    linked = truth > 0
    part = np.log2(np.maximum(truth, 1)).astype(np.int64)
    share = np.minimum(found, truth) / np.maximum(truth, 1)
    return min((share[linked & (part == p)].mean() for p in np.unique(part[linked])), default=1.0)


def near_duplicates(embeddings: DataFrame, least: float = 0.9, overlap: int = 2, recall: float = 0.97, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings``."""
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    rows = cut_lineage(usable(embeddings).withColumn("embedding", F.col("embedding").cast("array<float>")))
    classes = cut_lineage(rows.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    nodes = classes.select(F.col("node").alias("vec_id"), "weight", "embedding")
    total = nodes.count()
    if not total:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    _, fitted = sample(nodes, SAMPLE, seed)
    centers = centroids(unit(fitted), max(1, min(CENTROIDS, math.ceil(total / SHARD), len(fitted))))
    audit_ids, audit = sample(nodes, AUDIT, seed + 1)
    truth = _true_links(nodes, audit_ids, audit, least)
    while True:
        placed = cut_lineage(_shards(nodes, centers, overlap))
        found = cut_lineage(_searched(placed, _lists(placed), least))
        audited = found.where(F.col("vec_id").isin([int(i) for i in audit_ids])).groupBy("vec_id").agg(F.sum("met").alias("n")).collect()
        got = {r["vec_id"]: r["n"] for r in audited}
        worst = _worst(np.array([got.get(int(i), 0) for i in audit_ids]), truth)
        if worst >= recall:
            break
        if overlap >= min(MOST_OVERLAP, len(centers)):
            log.warning("recall %.3f with %d shards a node: all links are counted", worst, overlap)
            blocks = centroids(unit(fitted), max(1, min(CENTROIDS, math.ceil(total / BLOCK), len(fitted))))
            found = cut_lineage(_every_link(nodes, blocks, least))
            break
        overlap += 1
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    members = rows.join(classes, "embedding").select("vec_id", "node", "weight")
    counted = members.join(links.withColumnRenamed("vec_id", "node"), "node", "left")
    counted = counted.select("vec_id", "node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    whole = connected(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    done = counted.join(whole.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    done = done.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min(F.coalesce("component", "node")).alias("component_id"))
    out = every.join(done, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
