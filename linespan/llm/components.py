"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linespan.llm.common import drop_written, materialise


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    """For each key its least neighbour; hubs are reduced before the shuffle."""
    return edges.groupBy(F.col(key).alias("_key")).agg(F.min(other).alias("_least"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge the smallest node it can reach.

    Every round is written to the shared folder, the one before it is deleted, and the loop ends when a round leaves the
    same set of edges, so neither edges nor components come to the driver (only their number). Loops and repeated edges
    are ignored; an edge with a null end links nothing; without edges the result is empty.
    """
    own = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    now = materialise(own.distinct(), "components")
    size = now.count()
    while size:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, "u", "v").select("_key", F.least("_key", "_least").alias("_least"))
        # large star: larger neighbours go to the least neighbour
        large = both.join(least, F.col("u") == F.col("_key")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_least").alias("v")).distinct()
        # small star: so do the node and its smaller neighbours
        joined = large.join(_least(large, "u", "v"), F.col("u") == F.col("_key"))
        small = joined.where(F.col("v") != F.col("_least")).select(F.col("v").alias("u"), F.col("_least").alias("v"))
        was, before = now, size
        now = materialise(small.unionByName(joined.select("u", F.col("_least").alias("v"))).distinct(), "components")
        size = now.count()
        same = size == before and now.join(was, ["u", "v"], "left_anti").isEmpty()  # sets of equal size
        drop_written(was)
        if same:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
