"""Two relations side by side by position, the shorter one starting over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows up to which a side is broadcast.
SMALL = 200_000


def balanced_zip(a: DataFrame, b: DataFrame, index: str = "i") -> DataFrame:
    """place, a's and b's columns: as many places as the longer has rows. Both have an index from 0 without gaps.

    A side of at most SMALL rows is broadcast, since each of its rows may stand at many places; of a longer side, no row
    stands at more than one place in SMALL. If either is empty, so is the result.
    """
    spark = a.sparkSession
    n, m = a.count(), b.count()
    if not n or not m:
        return spark.createDataFrame([], f"place bigint, a_{index} bigint, b_{index} bigint")
    places = spark.range(max(n, m)).select(F.col("id").alias("place"), (F.col("id") % n).alias(f"a_{index}"), (F.col("id") % m).alias(f"b_{index}"))
    left = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    small = lambda side, rows: F.broadcast(side) if rows <= SMALL else side
    return places.join(small(left, n), f"a_{index}").join(small(right, m), f"b_{index}")


def replicate(rows: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, in place: no join."""
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(max(times, 1))))).drop("_k") if times > 0 else rows.limit(0)
