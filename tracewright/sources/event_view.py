"""The events table read as recorded trajectories: a user is a family, a user's week a trajectory, an event a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The move that stands for each kind of event.
MOVES = {"signup": "idle", "click": "up", "view": "down", "purchase": "right", "error": "left"}
FIRST_DAY, WIN_VALUE = "2024-01-01", 50.0


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a step, in the schema that the operators take."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    week = F.floor(F.datediff(F.to_date("ts"), F.lit(FIRST_DAY)) / 7).cast("long")
    order = Window.partitionBy("trajectory_id").orderBy("ts", "event_id")
    moves = F.create_map(*(F.lit(x) for pair in MOVES.items() for x in pair))
    rows = events.select(F.col("user_id").alias("family_id"), week.alias("week"), "ts", "event_id", "event_type", "value")
    rows = rows.withColumn("trajectory_id", F.concat_ws("-w", F.col("family_id").cast("string"), F.col("week").cast("string")))
    rows = rows.withColumn("step", F.row_number().over(order) - 1).withColumn("before", F.lag("value").over(order))
    last = F.lead("event_id").over(order).isNull()
    return rows.select(
        "family_id",
        "trajectory_id",
        F.when(F.col("week") == 0, "base").otherwise("alt").alias("trajectory_kind"),
        F.concat(F.lit("t"), (F.col("family_id") % 4).cast("string")).alias("task_slug"),
        "week",
        "step",
        "event_id",
        moves[F.col("event_type")].alias("action"),
        F.when(F.col("event_type") == "click", "turn left").when(F.col("event_type") == "view", "turn right").otherwise(F.col("event_type")).alias("turn_action"),
        F.col("value").alias("reward"),
        (F.col("value") / WIN_VALUE).alias("progression"),
        F.floor(F.coalesce("before", F.lit(0.0)) / 25).cast("long").alias("obs_pre"),
        F.floor(F.col("value") / 25).cast("long").alias("obs_post"),
        last.alias("done"),
    )


def trajectories(steps_of: DataFrame) -> DataFrame:
    """One row a trajectory: what its first and last steps say. Partial aggregates only: no sort, no list of steps."""
    at = F.struct("step", "action", "event_id", "reward", "progression")
    found = steps_of.groupBy("family_id", "trajectory_id", "trajectory_kind", "task_slug", "week").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n_steps"), F.sum("reward").alias("episode_return")
    )
    return found.select(
        "family_id", "trajectory_id", "trajectory_kind", "task_slug", "week", "n_steps", "episode_return",
        F.col("first.action").alias("action_text"),
        F.col("last.reward").alias("terminal_reward"),
        F.col("last.progression").alias("terminal_progression"),
        (-(F.col("first.event_id") % 97) / 10.0).alias("ref_logprob"),
    )


def traces(steps_of: DataFrame) -> DataFrame:
    """One row a trajectory, as sources.traces has them, with the fields of a call that candidates look at."""
    extras = "struct<balrog_raw: struct<messages: array<struct<role: string, content: string>>, response: struct<raw_completion: string>>>"
    none = F.lit(None).cast("string")
    call = F.struct(
        F.lit("go on").alias("instruction"), F.col("obs_pre").cast("string").alias("observation"), none.alias("thought"), "action", none.alias("raw_output"),
        "reward", "progression", "done", F.lit(None).cast(extras).alias("extras"),
    )
    packed = F.array_sort(F.collect_list(F.struct("step", "event_id", call.alias("call"))), lambda a, b: a["step"] - b["step"])
    found = steps_of.groupBy("trajectory_id", "trajectory_kind", "task_slug").agg(packed.alias("s"))
    return found.select(F.col("trajectory_id").alias("episode_id"), F.col("trajectory_id").alias("trace_path"), "trajectory_kind", F.col("task_slug").alias("task_or_env_params"), F.lit(0).cast("long").alias("seed"), F.transform("s", lambda x: x["call"]).alias("calls"))
