"""From bases over divergence steps and alternatives to jobs; rounds of trying again; what a collection came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import branch_id
from .branching import prefix
from .resume import KEY, RETRYABLE, is_complete, latest


def bases_to_branch(bases: DataFrame, success_only: bool = False, smoke: bool = False, task: str = "task_slug", order: tuple[str, ...] = ("trajectory_id",)) -> DataFrame:
    """Bases to branch from: all, or successes; for a smoke run one a task, the first with more than one step, else the first."""
    rows = bases.where("is_success") if success_only else bases
    if not smoke:
        return rows
    rest = [c for c in rows.columns if c != task]
    first = F.min_by(F.struct(*rest), F.struct((F.col("n_steps") <= 1).alias("_short"), *order))
    return rows.groupBy(task).agg(first.alias("_r")).select(task, "_r.*")


def other_actions(valid: Column, taken: Column, most: int, excluded: Column | None = None) -> Column:
    """The first `most` valid actions (all for 0) in their order, each once, but the taken and the excluded ones."""
    clean = F.filter(F.array_distinct(F.transform(valid, F.trim)), lambda a: (a != "") & ~a.eqNullSafe(F.trim(taken)))
    clean = clean if excluded is None else F.array_except(clean, F.transform(excluded, F.trim))
    return F.slice(clean, 1, most) if most > 0 else clean


def jobs(bases: DataFrame, steps: Column, alternatives: Column) -> DataFrame:
    """A row a job: base, step, alternative and its index, the base's action there and all before it, and the branch's id.

    bases: task_slug, trajectory_id, actions; steps: an array of steps over bases; alternatives: an array over bases and
    divergence_step. Steps out of range and states without alternatives give no job. Nothing is shuffled.
    """
    at = bases.select("*", F.explode(steps).alias("divergence_step")).where((F.col("divergence_step") >= 0) & (F.col("divergence_step") < F.size("actions")))
    at = at.withColumn("base_action", F.try_element_at("actions", F.col("divergence_step").cast("int") + 1))
    rows = at.select("*", F.posexplode(alternatives).alias("alt_index", "alt_action"))
    return rows.select(
        "task_slug", F.col("trajectory_id").alias("base_traj_id"), F.col("divergence_step").cast("int").alias("divergence_step"), "alt_index", "base_action", "alt_action",
        prefix(F.col("actions"), F.col("divergence_step")).alias("prefix_actions"), branch_id(F.col("trajectory_id"), F.col("divergence_step").cast("int"), F.col("alt_index")).alias("alt_traj_id"),
    )


JOB_ORDER = ["task_slug", "base_traj_id", "divergence_step", "alt_index", "alt_action"]
RECORD_ORDER = ["task_slug", "seed", "base_traj_id", "divergence_step", "alt_traj_id"]


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows by range partitions in this order; missing texts stand as '', missing numbers as -1."""
    kinds = dict(rows.dtypes)
    return rows.orderBy(*(F.coalesce(F.col(c), F.lit("") if kinds[c] == "string" else F.lit(-1)) for c in order))


def next_round(wanted: DataFrame, records: DataFrame, most: int, key: list[str] = KEY) -> DataFrame:
    """Jobs to try again, with job_attempt: those without a complete record, of fewer than `most` attempts that may be repeated."""
    tried = records.groupBy(key).agg(F.count_if(F.col("status").isin(*RETRYABLE)).alias("_tries"), F.max(is_complete(F.col("status"), F.col("files_exist"))).alias("_done"))
    rows = wanted.join(tried, key, "left").where(~F.coalesce("_done", F.lit(False)) & (F.coalesce("_tries", F.lit(0)) < most))
    return rows.withColumn("job_attempt", F.coalesce("_tries", F.lit(0)) + 1).drop("_tries", "_done")


def with_attempts(records: DataFrame, key: list[str] = KEY, order: str = "ord") -> DataFrame:
    """The record of each key that holds, and how many there were."""
    return latest(records, key, order).join(records.groupBy(key).agg(F.count(F.lit(1)).alias("job_attempts")), key)


def by_status(records: DataFrame, by: list[str]) -> DataFrame:
    """Per group: records, those that were generated, replayed and won, and the others."""
    known = F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("unknown"))
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(known == "generated").alias("generated"), F.count_if(known == "replay_mismatch").alias("replay_mismatch"),
        F.count_if(known.isin(*RETRYABLE)).alias("retryable"), F.count_if(known == "unknown").alias("unknown"),
    )


def totals(summary: DataFrame) -> DataFrame:
    """generated and failed over all tasks, from the rows of branching.summary that stand for a whole task."""
    return summary.where("base_traj_id is null").agg(F.coalesce(F.sum("generated"), F.lit(0)).alias("generated"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.count(F.lit(1)).alias("tasks"))


def failure_fields(failures: DataFrame, key: list[str], order: str = "ord", reason: str = "reason") -> DataFrame:
    """Per key: the failures in order, how often each reason occurs, and the last one."""
    counts = failures.groupBy(*key, reason).agg(F.count(F.lit(1)).alias("n"), F.collect_list(order).alias("at")).groupBy(*key)
    packed = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.col(reason), F.col("n")))).alias("failure_counts"), F.flatten(F.collect_list(F.transform("at", lambda o: F.struct(o.alias("o"), F.col(reason).alias("r"))))).alias("_h"))
    history = F.transform(F.array_sort("_h"), lambda x: x["r"])
    return packed.select(*key, history.alias("failure_history"), "failure_counts", F.element_at(history, -1).alias("last_failure"))


