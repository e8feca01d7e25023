"""Operator 5: sharding by a consistent-hash ring with virtual nodes and bounded loads. DataFrame operations only.

The ring has a fixed number of cells; each shard has ``vnodes`` virtual nodes on it. A text's hash gives its cell,
and the cell belongs to the first virtual node clockwise. Cells are served in a seeded order; a shard takes bytes
until it holds ``(1 + slack)`` of the mean, and what overflows continues clockwise to the next shard that is not
full. So no shard is above its bound (but for half a group), and another number of shards moves only
what its new nodes take over or what overflows differently. The law that holds is ``bytes``.

Rows with equal texts share a hash and stay together. Only a text whose copies hold more than 1/16 of a shard is
hot: its rows are spread over the ring by their doc_id. The ring itself is a fold over one row a cell, whatever the
number of documents; documents are ordered inside (cell, sub-cell) pairs, whose number follows the rows.

Null text has size 1 and check sum 0 and is spread by doc_id; null doc_ids and repeated rows are rows like others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioscope.session import cut_lineage

CELLS = 4096
#: Copies of one text are spread once they hold this part of a shard; so at most 16 * shards texts are hot.
HOT_PART = 16
#: Rows of a (cell, sub-cell) pair, ordered in one task.
SUB_ROWS = 20_000


def node_cells(shards: int, vnodes: int, seed: int) -> list[list[int]]:
    """Cells of each shard's virtual nodes; a shard's nodes don't depend on the number of shards."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{seed}/{s}/{v}".encode(), digest_size=8).digest(), "big") % CELLS
    return [[place(s, v) for v in range(vnodes)] for s in range(shards)]


def _clockwise(cell: Column, nodes: list[list[int]]) -> Column:
    """Shards in the order in which their virtual nodes come from the cell on."""
    places = [F.array_min(F.transform(F.array(*map(F.lit, own)), lambda p: F.pmod(p - cell, F.lit(CELLS)))) for own in nodes]
    order = F.array_sort(F.array(*[F.struct(p.alias("far"), F.lit(s).alias("shard")) for s, p in enumerate(places)]))
    return F.transform(order, lambda x: x["shard"])


def _serve(cells: DataFrame, shards: int, limit: int, seed: int) -> DataFrame:
    """Fold over the cells in seeded order: (cell, shard, lo, hi), the bytes of a cell that a shard takes."""
    by_order = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "cell").alias("at"), "cell", "bytes", "shards")))
    empty = "cast(array() as array<struct<cell:bigint,shard:int,lo:bigint,hi:bigint>>)"
    start = F.expr(f"struct(array_repeat(0L, {shards}) as load, {empty} as pieces)")

    def cell_step(state: Column, cell: Column) -> Column:
        def shard_step(now: Column, shard: Column) -> Column:
            free = F.lit(limit) - F.element_at(now["load"], shard + 1)
            take = F.greatest(F.lit(0), F.least(cell["bytes"] - now["done"], free))
            piece = F.struct(cell["cell"].alias("cell"), shard.alias("shard"), now["done"].alias("lo"), (now["done"] + take).alias("hi"))
            return F.struct(
                F.transform(now["load"], lambda x, i: F.when(i == shard, x + take).otherwise(x)).alias("load"),
                F.when(take > 0, F.concat(now["pieces"], F.array(piece))).otherwise(now["pieces"]).alias("pieces"),
                (now["done"] + take).alias("done"),
            )

        first = F.struct(state["load"].alias("load"), state["pieces"].alias("pieces"), F.lit(0).cast("long").alias("done"))
        return F.aggregate(cell["shards"], first, shard_step, lambda x: F.struct(x["load"].alias("load"), x["pieces"].alias("pieces")))

    folded = cells.agg(F.aggregate(by_order, start, cell_step, lambda x: x["pieces"]).alias("pieces"))
    return folded.select(F.explode("pieces").alias("p")).select("p.*")


def shard_documents(
    docs: DataFrame, shards: int = 8, vnodes: int = 64, slack: float = 0.002, seed: int = 17,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    slim = cut_lineage(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.xxhash64(F.lit(seed), text), F.xxhash64(F.lit(seed), doc_id)).alias("same"),
            F.col(text).isNull().alias("bare"),
        )
    )
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    limit = int(total["bytes"] / shards * (1 + slack)) + 1
    hot = (
        slim.where("not bare").groupBy("same").agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") > total["bytes"] / (shards * HOT_PART)).select("same", F.lit(True).alias("hot"))
    )
    # At most 16 * shards texts can be hot, so this side is small at any size of the table.
    marked = slim.join(F.broadcast(hot), "same", "left")
    spread = F.coalesce("hot", "bare")
    subs = max(1, -(-total["rows"] // (CELLS * SUB_ROWS)))
    keyed = (
        marked.withColumn("member", F.when(spread, F.xxhash64("same", "doc_id")).otherwise(F.col("same")))
        .withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + 1), "member"), F.lit(CELLS)))
        .withColumn("sub", F.pmod(F.xxhash64(F.lit(seed + 2), "member"), F.lit(subs)))
        .select("doc_id", "size", "text_crc32", "member", "cell", "sub")
    )
    sub_bytes = keyed.groupBy("cell", "sub").agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    sub_start = sub_bytes.select("cell", "sub", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("sub_start"))
    cells = sub_bytes.groupBy("cell").agg(F.sum("bytes").alias("bytes"))
    cells = cells.withColumn("shards", _clockwise(F.col("cell"), node_cells(shards, vnodes, seed)))
    pieces = _serve(cells, shards, limit, seed)

    # A group of equal texts is placed as a whole, by its middle.
    upto = Window.partitionBy("cell", "sub").orderBy("member").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("cell", "sub", "member")
    placed = keyed.withColumn("start", F.sum("size").over(upto) - F.ceil(F.sum("size").over(own) / 2))
    placed = placed.join(sub_start, ["cell", "sub"]).withColumn("start", F.col("start") + F.col("sub_start"))
    # At most CELLS * shards pieces.
    placed = placed.join(F.broadcast(pieces), "cell").where((F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi")))

    inside = Window.partitionBy("shard", "cell", "sub").orderBy("member", "doc_id", "size", "text_crc32")
    numbered = cut_lineage(placed.select("doc_id", "size", "text_crc32", "shard", "cell", "sub", (F.row_number().over(inside) - 1).alias("n")))
    before = Window.partitionBy("shard").orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("shard", "cell", "sub").count()
    first = counts.select("shard", "cell", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return numbered.join(first, ["shard", "cell", "sub"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
