"""What came before a row in its group, without a task for a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .branching import ranked


def windows(rows: DataFrame, group: str, order: list[str], width: int, item: list[str], name: str = "recent", block: int = 8_192) -> DataFrame:
    """rows with one more column: structs of `item` of the last `width` rows of the group up to each row, itself last.

    All rows are ranked by (group, order) and dealt in blocks of ranks, each with the `width` rows before it; so a group that
    holds most rows is spread over as many blocks as it needs. Rows that tie stand in the order of a hash.
    """
    block = max(block, 4 * width)
    placed, _ = ranked(rows, group, *order, name="_r")
    own = F.floor(F.col("_r") / block).cast("long")
    near_end = F.col("_r") % block >= block - (width - 1)
    dealt = placed.withColumn("_own", own).withColumn("_b", F.explode(F.when(near_end, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy("_b").orderBy("_r").rowsBetween(-(width - 1), 0)
    held = F.collect_list(F.struct(F.col(group).alias("_g"), F.struct(*item).alias("_x"))).over(w)
    found = dealt.withColumn("_w", held).where("_b = _own")
    alike = F.filter("_w", lambda x: x["_g"].eqNullSafe(F.col(group)))
    return found.withColumn(name, F.transform(alike, lambda x: x["_x"])).drop("_r", "_own", "_b", "_w")
