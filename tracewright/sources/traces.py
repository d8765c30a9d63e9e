"""Readers of trace, log, step and index files, and writers of the same and of results."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.casts import strip

MESSAGE = "STRUCT<role: STRING, content: STRING>"
CALL = (
    "STRUCT<call_idx: INT, episode_step: INT, instruction: STRING, observation: STRING, observation_post: STRING, thought: STRING, action: STRING, raw_output: STRING, feedback: STRING, "
    "reward: DOUBLE, progression: DOUBLE, done: BOOLEAN, won: BOOLEAN, lost: BOOLEAN, termination_reason: STRING, request_count: INT, step_wall_time_sec: DOUBLE, "
    "token_usage: STRUCT<input: INT, output: INT, total: INT>, "
    f"extras: STRUCT<balrog_raw: STRUCT<messages: ARRAY<{MESSAGE}>, response: STRUCT<raw_completion: STRING>>, abort_reason: STRING>>"
)
TRACE = f"schema_version STRING, benchmark STRING, env_name STRING, task_or_env_params STRING, episode_id STRING, episode_idx INT, seed BIGINT, num_calls INT, trajectory_kind STRING, calls ARRAY<{CALL}>, _corrupt STRING"
#: Columns of a step file, all read as text.
STEP_COLUMNS = (
    "step instruction observation_pre thought action_model action_executed raw_output feedback observation_post obs_changed reward progression terminated truncated done "
    "termination_reason action_defaulted input_tokens output_tokens step_wall_time_sec won lost"
).split()
TRACE_SUFFIX = "_llm_trace.json"


def _path() -> Column:
    return F.col("_metadata.file_path")


def is_branch_file(path: Column) -> Column:
    """Lies under a folder _dtc..., or is named as a branch."""
    return path.rlike(r"/_dtc[^/]*/") | F.element_at(F.split(path, "/"), -1).contains("__dtc_")


def traces(spark: SparkSession, folder: str, branches: list[str] | None = None) -> DataFrame:
    """All trace files below a folder, one row an episode: base episodes alone, or those of branches in the folders given
    besides (Spark's listing passes over folders that begin with an underscore, so these are named one by one).

    episode_id is the file's name without its suffix where the file names none. Files that don't parse have _corrupt.
    """
    rows = spark.read.schema(TRACE).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{TRACE_SUFFIX}").json([folder, *(branches or [])])
    rows = rows.select("*", _path().alias("trace_path")).withColumn("episode_id", F.coalesce(F.nullif(strip(F.col("episode_id")), F.lit("")), F.regexp_extract("trace_path", rf"([^/]*){TRACE_SUFFIX}$", 1)))
    return rows if branches else rows.where(~is_branch_file(F.col("trace_path")))


def with_calls(rows: DataFrame) -> DataFrame:
    """rows, or an error where an episode has no calls."""
    has = F.coalesce(F.size("calls"), F.lit(0)) > 0
    return rows.where(F.when(has, True).otherwise(F.raise_error(F.concat(F.lit("no calls in "), F.col("trace_path"))).cast("boolean")))


def steps_of(rows: DataFrame) -> DataFrame:
    return rows.select("episode_id", "trace_path", F.posexplode("calls").alias("step", "call")).select("episode_id", "trace_path", "step", "call.*")


def json_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True, non_empty: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; blank lines don't count. strict: any other line that is no object is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    if non_empty and rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def step_files(spark: SparkSession, folder: str, escape: str = "\\") -> DataFrame:
    """Rows of all step files below a folder, every value as text, with stem and folder. Files have a header; the escape
    character is the writer's."""
    schema = ", ".join(f"`{c}` STRING" for c in STEP_COLUMNS)
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", escape).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    path = _path()
    return rows.select("*", F.regexp_extract(path, r"([^/]*)\.csv$", 1).alias("stem"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"))


def episode_logs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All *_run_*.json below a folder but traces and summaries, with stem."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_run_*.json").json(folder)
    name = F.regexp_extract(_path(), r"([^/]*)\.json$", 1)
    return rows.select("*", name.alias("stem")).where(~F.col("stem").endswith("_llm_trace") & ~F.col("stem").endswith("_summary"))


def resolved(branches: DataFrame, files: DataFrame) -> DataFrame:
    """branches with trace_path: the named path where it exists, else the one file with the branch's id; none or several
    are an error."""
    direct = files.select(F.col("trace_path").alias("_direct"))
    by_id = files.groupBy("episode_id").agg(F.count(F.lit(1)).alias("_k"), F.min("trace_path").alias("_found"))
    met = branches.join(direct, F.col("output_trace") == F.col("_direct"), "left").join(by_id, F.col("alt_traj_id") == F.col("episode_id"), "left")
    fail = F.raise_error(F.concat(F.lit("no single trace for "), F.coalesce("alt_traj_id", F.lit("<missing>"))))
    return met.withColumn("trace_path", F.coalesce("_direct", F.when(F.col("_k") == 1, F.col("_found")).otherwise(fail.cast("string")))).drop("_direct", "_found", "_k", "episode_id")


def write_json_lines(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """One object a line, nulls written; by: a folder for each value."""
    out = rows.write.mode(mode).option("ignoreNullFields", False)
    (out.partitionBy(*by) if by else out).json(path)


def write_csv(rows: DataFrame, path: str, escape: str = "\\", mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).option("escape", escape).csv(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def portable(path: Column, root: str) -> Column:
    """A path below root, relative to it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1_000_000)).otherwise(path)


def manifest_text(values: dict) -> str:
    """JSON with sorted keys, two spaces in, and a line end."""
    return json.dumps(values, indent=2, sort_keys=True) + "\n"


def latest_run(names: list[str]) -> str:
    """The last folder by name."""
    if not names:
        raise ValueError("no run folders")
    return max(names, key=lambda n: PurePosixPath(n).name)


def with_ids(rows: DataFrame) -> DataFrame:
    """rows, or an error where neither a trace nor its file's name says which episode it is."""
    has = strip(F.col("episode_id")) != ""
    return rows.where(F.when(has, True).otherwise(F.raise_error(F.concat(F.lit("no episode id in "), F.col("trace_path"))).cast("boolean")))


def step_sequences(rows: DataFrame, column: str = "action_executed") -> DataFrame:
    """folder, stem and the values of a step file's column that aren't blank, in order of steps."""
    item = F.struct(F.col("step").try_cast("bigint").alias("at"), strip(F.col(column)).alias("v"))
    packed = rows.groupBy("folder", "stem").agg(F.array_sort(F.collect_list(F.when(strip(F.col(column)) != "", item))).alias("_s"))
    return packed.select("folder", "stem", F.transform("_s", lambda x: x["v"]).alias("values"))
