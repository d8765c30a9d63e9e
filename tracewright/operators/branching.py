"""Where to branch off a trajectory, how jobs are named and dealt, and what a collection came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..sources.shared import kept


def uniform_steps(total: Column, count: int) -> Column:
    """Steps 1 to total - 1: all for a count of 0 or too large a one, the last for 1, else both ends and even places between."""
    n = total.cast("long") - 1
    every = F.when(n >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    if count <= 0:
        return every
    if count == 1:
        return F.when(n >= 1, F.array(n)).otherwise(F.array().cast("array<bigint>"))
    between = [(F.bround(F.lit(k) * (n - 1) / F.lit(count - 1)) + 1).cast("long") for k in range(1, count - 1)]
    return F.when(n <= count, every).otherwise(F.array_sort(F.array_distinct(F.array(F.lit(1).cast("long"), n, *between))))


def spread_steps(candidates: Column, count: int) -> Column:
    """`count` of the candidate steps at even places; the middle one for 1, all for 0 or too large a count."""
    n = F.size(candidates)
    if count <= 0:
        return candidates
    if count == 1:
        return F.when(n <= 1, candidates).otherwise(F.array(F.element_at(candidates, F.floor(n / 2).cast("int") + 1)))
    at = lambda k: F.element_at(candidates, F.bround(F.lit(k) * (n - 1) / F.lit(count - 1)).cast("int") + 1)
    return F.when(n <= count, candidates).otherwise(F.array_sort(F.array_distinct(F.array(*(at(k) for k in range(count))))))


def prefix(actions: Column, step: Column) -> Column:
    """All actions before a step."""
    return F.slice(actions, F.lit(1), step.cast("int"))


def step_cap(*caps: Column) -> Column:
    """The least cap that is there."""
    return F.least(*caps)


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def ranked(rows: DataFrame, *order: str, name: str = "rank", parts: int | None = None) -> tuple[DataFrame, int]:
    """rows with their place from 0 in the order of columns, and their number; no window over all rows.

    Rows are dealt by ranges of the order and sorted there once, and written: counting and numbering see the same partitions
    whatever executors are lost. The driver gathers one number a partition. Rows that tie stand in the order of a hash of all their
    columns (maps and Variants aside); null keys come first; an empty table stays empty.
    """
    spark = rows.sparkSession
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = [F.xxhash64(*some)] if (some := [f"`{f.name}`" for f in rows.schema.fields if f.name not in order and _hashable(f.dataType)]) else []
    at, within = F.spark_partition_id(), F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(n, *order, *whole).sortWithinPartitions(*order, *whole).withColumns({"_p": at, "_i": within - F.shiftleft(at.cast("long"), 33)})
    written = kept(dealt)
    counts = {r["_p"]: r["count"] for r in written.groupBy("_p").count().collect()}
    before, seen = [], 0
    for p in sorted(counts):
        before.append((p, seen))
        seen += counts[p]
    offset = F.broadcast(spark.createDataFrame(before, "_p int, _before bigint"))  # a row a partition
    return written.join(offset, "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before"), seen


def shards(rows: DataFrame, order: str, workers: int, total: int | None = None) -> DataFrame:
    """rows with worker: contiguous runs of the order, one longer for the first workers.

    total: the number of rows that the runs are cut for, if not that of rows. Ties and nulls are as in ranked(). An empty
    table gives an empty one.
    """
    placed, seen = ranked(rows, order, name="_rank")
    base, more = divmod(seen if total is None else total, workers)
    rank, long = F.col("_rank"), more * (base + 1)
    worker = F.when(rank < long, F.floor(rank / (base + 1))).otherwise(more + F.floor((rank - long) / max(base, 1)))
    return placed.withColumn("worker", worker.cast("long")).drop("_rank")


def summary(branches: DataFrame) -> DataFrame:
    """Generated and failed branches per task, and per task, base and step."""
    done = F.col("status") == "generated"
    return branches.groupingSets([["task_slug"], ["task_slug", "base_traj_id", "divergence_step"]], "task_slug", "base_traj_id", "divergence_step").agg(
        F.count_if(done).alias("generated"), F.count_if(~done).alias("failed")
    )


def unfilled(wanted: DataFrame, records: DataFrame, key: list[str], status: str) -> DataFrame:
    """A record with this status for each wanted key that has none."""
    return wanted.join(records.select(key), key, "left_anti").withColumn("status", F.lit(status))


def rank_within(rows: DataFrame, group: str, *order: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
