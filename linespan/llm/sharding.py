"""Sharding by a hierarchical weighted hash tree.

A tree of region, rack and shard. A key descends it: at each level every child draws a weighted hash
(``-ln(u) / weight`` with ``u`` from the hash of key and child) and the smallest draw wins, so a child gets its
share of the weight and a change of weights moves keys only into the subtrees that gained. ``grow`` adds a shard
as a region of its own: then no other weight changes and rows move into the new shard only.

Everything is a DataFrame expression; the tree is a small value held by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linespan.llm.common import partitions

#: Bits of the hash that make the draw; doubles hold them exactly.
DRAW_BITS = 52


@dataclass(frozen=True)
class Tree:
    """Regions of racks of (shard, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def even(cls, shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
        """Shards 0 to ``shards`` - 1 of weight 1, filled rack by rack."""
        if shards < 1:
            raise ValueError("a tree needs at least one shard")
        own = [tuple((i, 1.0) for i in range(k, min(k + per_rack, shards))) for k in range(0, shards, per_rack)]
        return cls(tuple(tuple(own[k : k + racks]) for k in range(0, len(own), racks)))

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, as a region of its own."""
        new = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return Tree((*self.regions, (((new, weight),),)))


def _draw(key: Column, node: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 64 - DRAW_BITS) + F.lit(0.5)) / F.lit(float(2**DRAW_BITS))
    return -F.log(u) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw (ties: the first child)."""
    if len(children) == 1:
        return children[0][2]
    drawn = [(_draw(key, node, weight), value) for node, weight, value in children if weight > 0]
    least = F.least(*[d for d, _ in drawn]) if len(drawn) > 1 else drawn[0][0]
    out = drawn[-1][1]
    for d, value in reversed(drawn[:-1]):
        out = F.when(d == least, value).otherwise(out)
    return out


def assign(key: Column, tree: Tree) -> Column:
    """The shard of ``key``. A null key is a key like any other (it goes where the key '' with a mark goes)."""
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    weigh = lambda part: sum(w for rack in part for _, w in rack)
    regions = []
    for i, region in enumerate(tree.regions):
        racks = []
        for j, rack in enumerate(region):
            leaves = [(f"shard {s}", w, F.lit(s)) for s, w in rack]
            racks.append((f"rack {i}.{j}", sum(w for _, w in rack), _pick(key, leaves)))
        regions.append((f"region {i}", weigh(region), _pick(key, racks)))
    return _pick(key, regions).cast("int")


def slots(df: DataFrame, shard: str, key: str, tie: list[str], slot: str = "slot") -> DataFrame:
    """Numbers the rows of every shard from 0 without a gap.

    A shard may hold any part of all rows, so it isn't ordered in one task: rows are numbered in hash buckets of a
    shard, as many as there are shuffle partitions, and each bucket starts where the ones before it end.
    Rows that agree in ``key`` and ``tie`` are alike, so their order among themselves doesn't matter.
    """
    buckets = max(8, partitions(df.sparkSession))
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = cut.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy(shard, "_bucket").orderBy(key, *tie)
    ranked = cut.withColumn("_rank", F.row_number().over(own))
    # starts has shards x buckets rows, whatever the input: its size is bounded by the configuration
    return (
        ranked.join(F.broadcast(starts), (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(slot, (F.col("_from") + F.col("_rank") - 1).cast("long"))
        .drop("_bucket", "_s", "_b", "_from", "_rank")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Law ``key``: doc_id and the number of shards decide; one more shard takes rows only into itself.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, a row for each row of ``docs``.
    Null text: size 1 and the checksum of no bytes. Null doc_id: a key like any other. Repeated rows go to the
    same shard, each with a slot of its own. Other columns are ignored; an empty table gives no rows.
    """
    tree = Tree.even(shards)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        assign(F.col("doc_id"), tree).alias("shard"),
        assign(F.col("doc_id"), tree.grow()).alias("grown_shard"),
    )
    return slots(rows, "shard", "doc_id", ["text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
