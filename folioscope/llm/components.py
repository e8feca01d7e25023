"""Connected components of a table of links, in Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    # A sum of hashes modulo 2**31 tells whether a round changed the links.
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def _least(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("a").agg(F.min("b").alias("least"))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link to another.

    Large-star and small-star rounds in turn until nothing changes; each round hangs every node's larger (then
    smaller) neighbours on its least one. A node with very many neighbours is one key of a join, which adaptive
    execution splits; its least neighbour is found with map-side aggregation. Rounds grow with the logarithm of
    the longest path. Null ends are ignored; an empty table gives an empty one.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).withColumn("least", F.least("a", "least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = cut_lineage(large)
        least = _least(large)  # every link points from the larger node
        small = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.union(least.select("a", F.col("least").alias("b"))).where("a <> b")
        edges = cut_lineage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
