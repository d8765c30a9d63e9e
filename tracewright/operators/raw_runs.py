"""Raw traces with their sibling logs as typed trajectories: each field from the first place that says it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V
from ..sources.artifacts import first_table
from ..sources.commits import commit, exists
from ..sources.traces import TRACE_SUFFIX, is_branch_file, portable

#: What a step's metadata has of its call, and a trajectory's of its trace.
OF_CALL = ["call_idx", "thought", "feedback", "observation_post", "token_usage", "won", "lost", "termination_reason", "action_defaulted"]
OF_TRACE = ["env_name", "schema_version", "episode_idx"]
OF_EITHER = ["base_seed", "seed_mode"]
#: What a log's score may be called, in the order that they count; and a call's.
LOG_SCORES, CALL_SCORES = ["score", "progression", "episode_return", "reward"], ["progression", "reward"]


def raw_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """path, folder, stem and text of all base traces below a folder, and of all other JSON files there, which may be their logs."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    rows = rows.select(path.alias("path"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name"), F.col("value").alias("text"))
    is_trace = F.col("name").endswith(TRACE_SUFFIX)
    stem = lambda ending: F.expr(f"left(name, length(name) - {len(ending)})")
    traces = rows.where(is_trace & ~is_branch_file(F.col("path"))).withColumn("stem", stem(TRACE_SUFFIX)).drop("name")
    return traces, rows.where(~is_trace).withColumn("stem", stem(".json")).drop("name")


def _text_of_first(v: Column, *names: str) -> Column:
    """The first of these fields that counts as true, as text; null without one."""
    return V.let(V.first_true(v, *names), lambda x: F.when(V.truth(x), V.text(x)))


def _step(call: Column, i: Column, path: Column) -> Column:
    more = {n: V.field(call, n) for n in OF_CALL}
    meta = F.struct(path.alias("source_trace_path"), V.number(V.field(call, "progression")).alias("progression"), *(c.alias(n) for n, c in more.items()))
    done = F.coalesce(V.truth(V.first_true(call, "done", "terminated")), F.lit(False))
    raw = V.let(V.field(call, "raw_output"), lambda x: F.when(~F.is_variant_null(x), V.text(x)))
    return F.struct(
        F.coalesce(V.whole(V.field(call, "episode_step")), i.cast("bigint")).alias("step_index"), F.coalesce(_text_of_first(call, "observation", "observation_pre"), F.lit("")).alias("observation"),
        F.coalesce(_text_of_first(call, "action", "action_executed", "action_model"), F.lit("")).alias("action"), raw.alias("raw_model_output"), V.number(V.field(call, "reward")).alias("reward"), done.alias("done"),
        F.to_json(meta, {"ignoreNullFields": "false"}).alias("metadata"),
    )


def won(trace: Column, log: Column, calls: Column) -> Column:
    """What the log says (success, then won), then the trace; then full progression in the log, then any call that won."""
    said = lambda v, n: V.let(V.field(v, n), lambda x: F.when(~F.is_variant_null(x), V.truth(x)))
    full = F.when(V.number(V.field(log, "progression")) >= 1.0, True)
    any_call = F.coalesce(F.exists(calls, lambda c: F.coalesce(V.truth(V.field(c, "won")), F.lit(False))), F.lit(False))
    return F.coalesce(said(log, "success"), said(log, "won"), said(trace, "won"), full, any_call)


def score(log: Column, calls: Column) -> Column:
    """The log's first score; without one, the last call's that has progression or reward, in this order within a call."""
    of_calls = F.filter(F.transform(calls, lambda c: F.when(V.is_object(c), V.first_number(c, *CALL_SCORES))), lambda x: x.isNotNull())
    return F.coalesce(V.first_number(log, *LOG_SCORES), F.try_element_at(of_calls, F.lit(-1)))


def normalised(traces: DataFrame, logs: DataFrame, benchmark: str, task: str | None = None, model: str = "", seed: int = 0, root: str = "") -> DataFrame:
    """A typed trajectory for each trace (path, folder, stem, text) whose calls are a list, with its log of the same folder and
    stem, where there is one; others are dropped.

    Fields fall back: the task on the trace, the log, `task`, the benchmark; the id on the stem; model and seed on those given.
    A trace that is no JSON object is an error, as is a log; paths in metadata are those below root.
    """
    sound = lambda c, what: F.when(V.is_object(c), c).otherwise(F.parse_json(F.raise_error(F.concat(F.lit(f"{what} is no JSON object: "), F.col("path"))).cast("string")))
    own = logs.select("folder", "stem", F.col("text").alias("_log"), F.col("path").alias("_log_path"))
    rows = traces.join(own, ["folder", "stem"], "left")
    rows = rows.select("path", "stem", "_log_path", F.try_parse_json("text").alias("t"), F.when(F.col("_log").isNotNull(), F.try_parse_json("_log")).otherwise(F.parse_json(F.lit("{}"))).alias("l"))
    rows = rows.withColumns({"t": sound(F.col("t"), "trace"), "l": sound(F.col("l"), "log")}).withColumn("calls", V.items(V.field(F.col("t"), "calls"))).where("calls is not null")
    t, log, calls = F.col("t"), F.col("l"), F.col("calls")
    below = lambda c: portable(c, root) if root else c
    steps = F.filter(F.transform(calls, lambda c, i: F.when(V.is_object(c), _step(c, i, below(F.col("path"))))), lambda s: s.isNotNull())
    meta = F.struct(
        F.lit("native_raw_trace").alias("source"), below(F.col("path")).alias("trace_path"), below(F.col("_log_path")).alias("episode_path"), F.regexp_replace(below(F.col("path")), f"{TRACE_SUFFIX}$", ".csv").alias("csv_path"),
        *(V.field(t, n).alias(n) for n in OF_TRACE), *(F.when(V.truth(V.field(t, n)), V.field(t, n)).otherwise(V.field(log, n)).alias(n) for n in OF_EITHER),
    )
    return rows.select(
        F.lit(benchmark).alias("benchmark"), F.coalesce(_text_of_first(t, "task_or_env_params"), _text_of_first(log, "task"), F.lit(task or benchmark)).alias("task_id"),
        F.coalesce(_text_of_first(t, "episode_id"), F.col("stem")).alias("trajectory_id"), F.coalesce(_text_of_first(t, "model_id"), F.lit(model)).alias("model_id"),
        F.coalesce(V.whole(V.field(t, "seed")), F.lit(seed).cast("bigint")).alias("seed"), won(t, log, calls).alias("won"), score(log, calls).alias("score"), steps.alias("steps"),
        F.to_json(meta, {"ignoreNullFields": "false"}).alias("metadata"),
    )


def checked(trajectories: DataFrame, expected: int | None = None) -> DataFrame:
    """trajectories, or an error: there are some, as many as expected, and one at least has an action."""
    found, acting = trajectories.agg(F.count(F.lit(1)), F.count_if(F.exists("steps", lambda s: F.trim(s["action"]) != ""))).first()
    if not found:
        raise ValueError("no trajectories")
    if expected is not None and found != expected:
        raise ValueError(f"{found} trajectories, {expected} expected")
    if not acting:
        raise ValueError("no trajectory has an action")
    return trajectories


def base_source(spark: SparkSession, folder: str, benchmark: str, into: str | None = None, **more) -> DataFrame:
    """The base trajectories of an earlier run: its file of trajectories, or else its raw traces, normalised and checked.

    into: where those are then committed as JSON lines, with a summary in the manifest.
    """
    root = folder.rstrip("/")
    for name in ("trajectories.jsonl", "base_trajectories.jsonl"):
        if exists(spark, f"{root}/{name}"):
            return first_table(spark, root)
    rows = checked(normalised(*raw_files(spark, root), benchmark, root=root, **more))
    if into:
        n, wins = rows.agg(F.count(F.lit(1)), F.count_if("won")).first()
        commit(rows, into, {"artifact_type": "base_trajectory_summary", "benchmark": benchmark, "num_trajectories": n, "num_success": wins})
    return rows


def collected_win(trace: Column, log: Column) -> Column:
    """Whether a collected episode is a success: its last call won, or full progression, or it ended with a return.

    Progression, return and end are the log's where it names them, be it as null, which counts as 0 or not; else the last call's.
    """
    last = V.let(V.items(V.field(trace, "calls")), lambda c: F.try_element_at(c, F.lit(-1)))

    def read(call: Column) -> Column:
        own = lambda name, other: F.coalesce(V.field(log, name), V.field(call, other))
        progression, total = F.coalesce(V.number(own("progression", "progression")), F.lit(0.0)), F.coalesce(V.number(own("episode_return", "reward")), F.lit(0.0))
        done = F.coalesce(V.truth(own("done", "done")), F.lit(False))
        return F.coalesce(V.truth(V.field(call, "won")), F.lit(False)) | (progression >= 1.0) | (done & (total > 0.0))

    return V.let(last, read)
