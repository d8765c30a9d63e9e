"""Connected components of an undirected graph in DataFrame operations: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """u and m, the least of u and its neighbours; aggregated before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, its least reachable node, of each node that has an edge to another; edges: columns a and b.

    Nodes are of any type with an order. Nulls, loops and repeated edges don't matter. An empty table gives an empty one.
    Driver state is two numbers a round. The edges of a hub meet its least neighbour in an inner join, whose partitions
    adaptive execution splits where one is large, since the other side is one row a node.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where(F.col("u") != F.col("v"))
        small = down.join(_least(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(_least(down).withColumnRenamed("m", "v")).where(F.col("u") != F.col("v")).distinct()
        now = cut(small)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
