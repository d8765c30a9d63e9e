"""Supervised rows from the calls of traces, what they sum up to, and which of their text is learnt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import strip
from ..functions.text import task_slug
from .candidates import prompt_of, response_of

ACTION_MARK = "Action:"


def of_task(task: Column, wanted: str | None) -> Column:
    """The task is the wanted one, by its id or by what follows its last slash; without a wish, always."""
    return F.lit(True) if wanted is None else (strip(task) == wanted.strip()) | (task_slug(task, "") == wanted.strip())


def rows_from_calls(traces: DataFrame, is_success: Column, success_only: bool = False, task: str | None = None) -> DataFrame:
    """One row for each call with a prompt, a completion and an action; what its trajectory came to stands in each.

    is_success: over task_or_env_params and `last`, the last call. Traces without calls give no rows, an empty table none.
    """
    last = F.try_element_at("calls", F.lit(-1))
    rows = traces.where(of_task(F.col("task_or_env_params"), task) & (F.size(F.coalesce("calls", F.array().cast(traces.schema["calls"].dataType))) > 0)).withColumn("last", last)
    rows = rows.withColumn("won", F.coalesce(is_success, F.lit(False)))
    rows = rows.where("won") if success_only else rows
    at = rows.select(
        strip(F.col("task_or_env_params")).alias("task_id"), F.coalesce("seed", F.lit(-1)).cast("long").alias("seed"), F.col("episode_id").alias("family_id"), F.col("episode_id").alias("trajectory_id"),
        F.col("won").alias("trajectory_success"), F.coalesce("last.progression", F.lit(0.0)).alias("trajectory_progress"), F.coalesce("last.reward", F.lit(0.0)).alias("trajectory_total_reward"),
        F.size("calls").alias("trajectory_total_steps"), F.col("trace_path").alias("source_trace"), F.posexplode("calls").alias("place", "call"),
    )
    call = F.col("call")
    step = F.coalesce(call["episode_step"], F.col("place")) if "episode_step" in traces.schema["calls"].dataType.elementType.names else F.col("place")
    made = at.select(
        prompt_of(call).alias("prompt"), F.array(F.struct(F.lit("assistant").alias("role"), response_of(call).alias("content"))).alias("completion"), "task_id", "seed", "family_id", "trajectory_id",
        F.lit("base").alias("trajectory_kind"), step.cast("int").alias("episode_step"), F.lit(None).cast("int").alias("divergence_step"), F.lit(None).cast("string").alias("state_key"),
        strip(call["action"]).alias("action_text"), "trajectory_success", "trajectory_progress", "trajectory_total_reward", "trajectory_total_steps", "source_trace",
    )
    return made.where((F.size("prompt") > 0) & (F.col("completion")[0]["content"] != "") & (F.col("action_text") != ""))


def task_counts(rows: DataFrame, traces: DataFrame, task: str | None = None) -> DataFrame:
    """Per task, and with a null task over all: trajectories with rows, trajectories without, and rows."""
    per = rows.groupBy("source_trace").agg(F.count(F.lit(1)).alias("n"))
    asked = traces.where(of_task(F.col("task_or_env_params"), task)).select(F.col("trace_path").alias("source_trace"), task_slug(F.col("task_or_env_params"), "<missing>").alias("task"))
    met = asked.join(per, "source_trace", "left").rollup("task")
    return met.agg(F.count("n").alias("trajectory_count"), F.count_if(F.col("n").isNull()).alias("skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("output_rows"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: rows, families, trajectories, and the most messages of a prompt and a completion; empty ids don't count."""
    some = lambda c: F.countDistinct(F.nullif(F.col(c), F.lit("")))
    most = lambda c: F.coalesce(F.max(F.size(c)), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("row_count"), some("family_id").alias("family_count"), some("trajectory_id").alias("trajectory_count"), most("prompt").alias("max_prompt_messages"), most("completion").alias("max_completion_messages"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value; a missing or empty value is 'unknown'."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    return rows.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("rows"))


def loss_start(full: Column, prompt: Column, action_only: bool = False) -> Column:
    """The place (from 0) in the full text from which it is learnt: behind the prompt, or the last action mark there; an error without one."""
    begin = F.length(prompt)
    if not action_only:
        return begin
    rest = F.substring(full, begin + 1, F.length(full))
    back = F.locate(ACTION_MARK[::-1], F.reverse(rest))
    return F.when(back > 0, F.length(full) - (back - 1) - len(ACTION_MARK)).otherwise(F.raise_error(F.lit("no action mark in the completion")).cast("int"))


def loss_mask(ends: Column, start: Column) -> Column:
    """1 for each token that ends behind the start, from the tokens' end places."""
    return F.transform(ends, lambda e: (e > start).cast("int"))
