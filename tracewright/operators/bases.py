"""Base episodes of earlier runs: found, pooled, counted and projected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import duplicates
from .planning import in_order
from .records import of_tasks
from .trace_rows import of_task
from .zip import replicate

#: Files that say what an evaluation came to, and those that don't.
SUMMARIES = ["summary.json", "results.json", "eval_summary.json"]
NO_SUMMARIES = ["native_command_manifest.json", "normalization_summary.json", "stage_manifest.json", "checkpoint_manifest.json", "run_metadata.json"]


def with_trace(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with trace_path: the first file by path of the row's episode; null without one."""
    first = files.groupBy("episode_id").agg(F.min("trace_path").alias("trace_path"))
    return rows.join(first, "episode_id", "left")


def of_run(bases: DataFrame, task: str | None = None) -> DataFrame:
    """Base episodes of the wanted task (of all for none), by task, then episode, stem and path."""
    return in_order(bases.where(of_task(F.col("task_id"), task)), ["task_id", "episode_idx", "run_stem", "trace_path"])


def manifest_rows(bases: DataFrame) -> DataFrame:
    """What a manifest says of the bases that were chosen; no return and no progression are 0."""
    own = ["task_id", "episode_id", "run_stem", "seed", "csv_path", "json_path", "trace_path", "total_steps", "success"]
    return bases.select(*own, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("episode_return", "progression")))


def pooled(runs: dict[str, DataFrame], tasks: DataFrame | None = None, key: str = "trajectory_id") -> DataFrame:
    """All runs as one, with the name of their source; an episode that several bring, or a wanted task without any, is an error."""
    if not runs:
        raise ValueError("no runs to pool")
    rows = reduce(DataFrame.unionByName, (r.withColumn("source", F.lit(name)) for name, r in runs.items()))
    rows = rows if tasks is None else of_tasks(rows, tasks)
    if twice := [r[0] for r in duplicates(rows, key).orderBy(key).limit(5).collect()]:
        raise ValueError(f"in several runs: {twice}")
    return rows


def counts(bases: DataFrame, by: list[str] | None = None, actions: str = "actions", won: str = "is_success") -> DataFrame:
    """Trajectories, those that won, and actions that are not empty; per group or over all."""
    some = F.size(F.filter(F.coalesce(F.col(actions), F.array().cast("array<string>")), lambda a: F.trim(a) != ""))
    return bases.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("trajectories"), F.count_if(won).alias("wins"), F.coalesce(F.sum(some.cast("long")), F.lit(0)).alias("actions"))


def supervised_counts(rows: DataFrame) -> DataFrame:
    """One row: records, distinct trajectories, and the tasks in order."""
    return rows.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("trajectory_id").alias("trajectories"), F.array_sort(F.collect_set("task_id")).alias("tasks"))


def first_environment(environments: Column) -> Column:
    """The payload of the first environment of a map; null without one."""
    return F.try_element_at(F.map_values(environments), F.lit(1))


def summary_files(paths: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """path and rank of the files that may say what an evaluation came to: three by name in the folder, then others below it by path."""
    root = folder.rstrip("/") + "/"
    name = F.substring_index(path, "/", -1)
    place = F.coalesce(*(F.when(F.col(path) == root + n, F.lit(i)) for i, n in enumerate(SUMMARIES)), F.lit(len(SUMMARIES)))
    fits = F.col(path).startswith(root) & ~name.isin(*NO_SUMMARIES) & (name.isin(*SUMMARIES) | name.endswith("_summary.json"))
    return paths.where(fits).select(path, place.alias("rank")).distinct().orderBy("rank", path)


def training_records(win_lose: DataFrame, win_win: DataFrame | None = None, mode: str = "win_lose", repeats: int = 1) -> DataFrame:
    """The pairs that a trainer's mode takes: wins over losses alone, or those with pairs of wins, these `repeats` times."""
    if mode == "win_lose":
        return win_lose
    if mode != "win_lose+win_win" or win_win is None:
        raise ValueError(f"no pairs for mode {mode}")
    return win_lose.unionByName(replicate(win_win, repeats), allowMissingColumns=True)


def base_summary(trajectories: DataFrame) -> DataFrame:
    """One row: trajectories, those that won, and the task ids in order."""
    by_task = trajectories.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("won").alias("w"))
    return by_task.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_trajectories"), F.coalesce(F.sum("w"), F.lit(0)).alias("num_success"), F.array_sort(F.collect_list("task_id")).alias("task_ids"))


def task_slugs(*outputs: DataFrame, slug: str = "task_slug") -> DataFrame:
    """The slugs that any of the outputs has, each once."""
    return reduce(DataFrame.unionByName, (o.select(slug).distinct() for o in outputs)).distinct()


def branch_totals(branch_sets: DataFrame) -> DataFrame:
    """One row: branch sets, and branches in all of them."""
    return branch_sets.agg(F.count(F.lit(1)).alias("num_branch_sets"), F.coalesce(F.sum(F.greatest(F.size("branches"), F.lit(0))), F.lit(0)).cast("bigint").alias("num_branches"))


def nothing(spark: SparkSession, like: DataFrame) -> DataFrame:
    """No rows, in the columns of another table: what a stage that is passed over leaves."""
    return spark.createDataFrame([], like.schema)
