"""Supervised rows from conversations or traces, and how they are balanced and sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.casts import strip
from .branching import ranked


def rows_from_turns(turns: DataFrame, group: str = "conv_id", order: str = "turn", speaker: str = "assistant", most: int | None = None) -> DataFrame:
    """One row for each of the speaker's turns: the turn as completion, all turns before it (the last `most`, if given) as prompt.

    Turns without a role or text don't count; rows without a prompt or completion are left out.
    """
    said = turns.select(group, order, strip(F.col("role")).alias("role"), strip(F.col("text")).alias("content")).where("role <> '' and content <> ''")
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding if most is None else -most, -1)
    rows = said.withColumn("prompt", F.collect_list(F.struct("role", "content")).over(before))
    return rows.where((F.col("role") == speaker) & (F.size("prompt") > 0)).select(group, order, "prompt", F.array(F.struct("role", "content")).alias("completion"))


def history(turns: DataFrame, group: str = "conv_id", order: str = "turn", text: str = "text", most: int = 16) -> DataFrame:
    """group, order and the last `most` texts up to this one, joined by line ends."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-(most - 1), 0)
    return turns.select(group, order, F.array_join(F.collect_list(F.coalesce(text, F.lit(""))).over(w), "\n").alias("history"))


def index_at(place: Column, n: Column, target: Column) -> Column:
    """Which of n rows (from 0) stands at one of `target` places: in turn when growing, evenly spaced when shrinking."""
    return F.when(target >= n, place % n).otherwise(F.least(n - 1, F.floor((2 * place + 1) * n / (2 * target)))).cast("long")


def resampled_index(n: Column, target: Column) -> Column:
    """index_at() of all `target` places, as an array."""
    at = F.transform(F.sequence(F.lit(0).cast("long"), target.cast("long") - 1), lambda i: index_at(i, n, target))
    return F.when(target > 0, at).otherwise(F.array().cast("array<bigint>"))


#: Groups up to which their plan is made on the driver, and rows of a group up to which one task numbers them.
FEW_GROUPS, MOST_IN_TASK = 10_000, 1_000_000


def _planned(counts: DataFrame, group: str) -> tuple[DataFrame, int, int, int]:
    """group, _n, _rank and _start (rows of the groups before) of each group, the number of groups, of rows, and of the largest group's rows."""
    spark = counts.sparkSession
    few = counts.orderBy(group).limit(FEW_GROUPS + 1).collect()
    if len(few) <= FEW_GROUPS:
        rows, start = [], 0
        for k, r in enumerate(few):
            rows.append((r[group], r["_n"], k, start))
            start += r["_n"]
        kind = StructType([counts.schema[group], *StructType.fromDDL("_n bigint, _rank bigint, _start bigint").fields])
        return F.broadcast(spark.createDataFrame(rows, kind)), len(rows), start, max((r[1] for r in rows), default=0)
    first, groups = ranked(counts, group, name="_rank")
    total, largest = first.agg(F.sum("_n"), F.max("_n")).first()
    return first, groups, total, largest


def rebalanced(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows so that each group has the same number (the first groups one more), all together as many as before.

    place counts within a group. Each place computes which row stands there, and meets it by an equi-join on (group, row
    number); rows are numbered group by group in a window, or by ranges over all where a group is too large for one task. A
    null group is left out; an empty table gives an empty one.
    """
    rows = rows.where(F.col(group).isNotNull())
    planned, groups, total, largest = _planned(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), group)
    base, more = divmod(total or 0, max(groups, 1))
    slot, long = F.col("id"), more * (base + 1)
    of = F.when(slot < long, F.floor(slot / (base + 1))).otherwise(more + F.floor((slot - long) / max(base, 1))).cast("long")
    place = F.when(F.col("_rank") < more, slot - F.col("_rank") * (base + 1)).otherwise((slot - long) - (F.col("_rank") - more) * base)
    target = F.when(F.col("_rank") < more, base + 1).otherwise(base).cast("long")
    spots = rows.sparkSession.range(total or 0).select("id", of.alias("_rank")).join(planned.drop("_start"), "_rank")
    spots = spots.select(group, place.alias("place"), index_at(place, F.col("_n"), target).alias("_i"))
    if largest and largest > MOST_IN_TASK:
        placed, _ = ranked(rows, group, order, name="_r")
        starts = placed.groupBy(group).agg(F.min("_r").alias("_start"))
        indexed = placed.join(starts, group).withColumn("_i", F.col("_r") - F.col("_start")).drop("_r", "_start")
    else:
        indexed = rows.withColumn("_i", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("long"))
    return spots.join(indexed, [group, "_i"]).drop("_i")


def by_plan(rows: DataFrame, plan: DataFrame, index: str = "row_idx") -> DataFrame:
    """rows as often as the plan names their index."""
    return plan.select(index).join(rows, index)


def plan_summary(plan: DataFrame, index: str = "row_idx") -> DataFrame:
    found = plan.groupBy(index).agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("plan_rows"), F.count(F.lit(1)).alias("distinct_rows"))
    return found.withColumn("reuse_ratio", F.col("plan_rows") / F.greatest("distinct_rows", F.lit(1)))


def shuffled(rows: DataFrame, key: list[str], seed: str, epoch: int = 0) -> DataFrame:
    """rows in an order that hangs on seed, epoch and key alone, by range partitions; another epoch, another order.

    It is the order of a hash, not that of a generator that holds all rows. Rows of one key stand together.
    """
    return rows.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), *key), *key)


def checked_plan(plan: DataFrame, rows: int, index: str = "row_idx") -> DataFrame:
    """plan, or an error: it has rows, and each names one of the `rows` rows by a whole number. Nothing is dropped in a join."""
    if plan.isEmpty():
        raise ValueError("the plan has no rows")
    at = F.col(index).try_cast("bigint")
    wrong = F.concat(F.lit(f"{index} "), F.coalesce(F.col(index).cast("string"), F.lit("null")), F.lit(f" is out of range for {rows} rows"))
    sound = F.when((at >= 0) & (at < rows) & (at.cast("string") == F.col(index).cast("string")), True).otherwise(F.raise_error(wrong).cast("boolean"))
    return plan.where(sound)


def plan_report(plan: DataFrame, rows: int, index: str = "row_idx", mode: str = "mode") -> DataFrame:
    """One row: rows of the plan and of the source, different ones among the former, how often rows are taken on average of all
    and of those that are, and how many the plan takes in each mode (unknown without one), in order of the modes."""
    named = plan.select(index, F.coalesce(F.nullif(F.col(mode).cast("string"), F.lit("")), F.lit("unknown")).alias("_m"))
    sums = named.groupBy(index).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("plan_rows"), F.count(F.lit(1)).alias("distinct_rows"))
    modes = named.groupBy("_m").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_m", "n")))).alias("mode_counts"))  # a row a mode
    n, some = F.col("plan_rows"), F.col("distinct_rows")
    found = sums.crossJoin(F.broadcast(modes))  # one row each
    return found.select("plan_rows", F.lit(rows).cast("bigint").alias("source_rows"), "distinct_rows", (n / rows if rows else F.lit(0.0)).alias("resample_ratio"), F.when(some > 0, n / some).otherwise(0.0).alias("reuse_ratio"), "mode_counts")


def of_requested_task(rows: DataFrame, wanted: str | None, task: str = "task_id") -> DataFrame:
    """Rows of the wanted task, named whole or by what follows its last slash; all for none. A name that fits none or several is an error."""
    if wanted is None:
        return rows
    if not (name := wanted.strip()):
        raise ValueError("the task's name is empty")
    own = F.coalesce(F.nullif(F.col(task).cast("string"), F.lit("")), F.lit("unknown"))
    fits = rows.select(own.alias("t")).where((F.col("t") == name) | F.col("t").endswith("/" + name)).distinct().orderBy("t").limit(6).collect()
    names = [r["t"] for r in fits]
    if name not in names and len(names) != 1:
        raise ValueError(f"{name} is ambiguous: {', '.join(names)}" if names else f"no rows of task {name}")
    return rows.where(own == (name if name in names else names[0]))


def by_trajectory(rows: DataFrame, order: str) -> DataFrame:
    """rebalanced() over trajectories, or families where a row names none; a row with neither is an error."""
    own = F.coalesce(F.nullif(strip(F.col("trajectory_id")), F.lit("")), F.nullif(strip(F.col("family_id")), F.lit("")))
    return rebalanced(rows.withColumn("_group", F.coalesce(own, F.raise_error(F.lit("a row names neither trajectory nor family")).cast("string"))), "_group", order).drop("_group")


def training_rows(rows: DataFrame) -> DataFrame:
    return rows.select("prompt", "completion")
