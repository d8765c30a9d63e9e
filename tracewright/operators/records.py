"""Typed records for trainers and reports: texts of loosely typed sides, prompts of branch sets, splits and their checks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.casts import strip
from .checks import missing, require


def _item(x: object) -> str:
    return str(x.get("content") or "") if isinstance(x, dict) else str(x)


def _side(raw: str | None) -> str:
    if raw is None:
        return ""
    try:
        said = json.loads(raw)
    except ValueError:
        return raw
    if isinstance(said, dict):
        return str(next((v for name in ("action_text", "content", "text") if (v := said.get(name))), "")).strip()
    if isinstance(said, list):
        return "\n".join(t for x in said if (t := _item(x))).strip()
    return said if isinstance(said, str) else raw


@F.pandas_udf(StringType())
def side_text(raw: pd.Series) -> pd.Series:
    """The text of a side in JSON: an object's action, content or text; a list's contents in lines; any other text as it is."""
    return raw.map(_side)


def call_prompt(calls: Column, step: Column, fallback: Column) -> Column:
    """Instruction and observation of the call at a step (from 0), a blank line between; the fallback without any."""
    call = F.try_element_at(calls, step.cast("int") + 1)
    parts = F.filter(F.array(strip(call["instruction"]), strip(call["observation"])), lambda p: p != "")
    return F.when((step >= 0) & (F.size(parts) > 0), F.array_join(parts, "\n\n")).otherwise(fallback)


def with_prompts(branch_sets: DataFrame, bases: DataFrame) -> DataFrame:
    """Branch sets with the prompt of their base at their step; without that trace, the state key."""
    held = bases.groupBy(F.col("episode_id").alias("base_traj_id")).agg(F.min_by("calls", "trace_path").alias("_calls"))
    rows = branch_sets.join(held, "base_traj_id", "left")
    return rows.withColumn("prompt", call_prompt(F.col("_calls"), F.col("divergence_step"), F.coalesce("state_key", F.lit("")))).drop("_calls")


def branch_details(calls: Column, step: Column, won: Column) -> Column:
    """action, response_text, won and score of a branch's trace; the step is moved into range, a trace without calls gives nulls."""
    last = F.try_element_at(calls, F.lit(-1))
    call = F.try_element_at(calls, F.greatest(F.least(step.cast("int"), F.size(calls) - 1), F.lit(0)) + 1)
    score = F.coalesce(F.nullif(last["progression"], F.lit(0.0)), last["reward"])
    action = strip(call["action"])
    text = F.coalesce(F.nullif(strip(call["raw_output"]), F.lit("")), F.concat(F.lit("Action: "), action))
    return F.when(F.size(calls) > 0, F.struct(action.alias("action"), text.alias("response_text"), F.coalesce(won, score >= 1.0, F.lit(False)).alias("won"), score.alias("score")))


def trainer_rows(records: DataFrame, balanced: bool = False) -> DataFrame:
    """prompt, chosen and rejected; for the balanced trainer also the pair's type, target and weight."""
    own = ["prompt", "chosen", "rejected"]
    return records.select(*own, "pair_type", "target_prob", "weight") if balanced else records.select(*own)


def one_type(records: DataFrame, pair_type: str) -> DataFrame:
    """records, or an error: a file of one type of pairs has rows, all of that type, and of wins over losses all with target 1."""
    if records.isEmpty():
        raise ValueError(f"no {pair_type} pairs")
    sure = (F.abs(F.col("target_prob") - 1.0) <= 1e-6) if pair_type == "win_lose" else F.col("target_prob").between(0.0, 1.0)
    return require(records, {f"pair is {pair_type}": F.col("pair_type") == pair_type, "target fits the type": sure})


def of_tasks(rows: DataFrame, tasks: DataFrame, key: str = "task_slug") -> DataFrame:
    """Rows of the wanted tasks, or an error that names tasks without any."""
    lacking = [r[0] for r in missing(tasks, rows, key).orderBy(key).limit(5).collect()]
    if lacking:
        raise ValueError(f"no rows for {lacking}")
    return rows.join(tasks.select(key).distinct(), key, "left_semi")


def check_bases(trajectories: DataFrame, expected: int) -> DataFrame:
    """trajectories, or an error: as many as expected, each with at least one action."""
    if (found := trajectories.count()) != expected or not found:
        raise ValueError(f"{found} trajectories, {expected} expected")
    return require(trajectories, {"an action is not empty": F.exists("actions", lambda a: F.trim(a) != "")})


def check_supervised(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """rows, or an error: all of successes, and some for each task."""
    return of_tasks(require(rows, {"trajectory succeeded": F.col("trajectory_success")}), tasks)


def successes(episodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Episodes, successes and their share, per group or over all; 0 without episodes."""
    found = (episodes.groupBy(*by) if by else episodes.groupBy()).agg(F.count(F.lit(1)).alias("episodes"), F.count_if("is_success").alias("successes"))
    return found.withColumn("success_rate", F.when(F.col("episodes") > 0, F.col("successes") / F.col("episodes")).otherwise(0.0))


def steps_per_epoch(rows: int, batch: int, accumulated: int = 1) -> int:
    return max(1, -(-rows // (batch * accumulated)))


def newest(names: DataFrame, name: str = "name") -> DataFrame:
    """The name with the largest number behind its last hyphen, such as checkpoint-120; names without one don't count."""
    number = F.regexp_extract(name, r"-(\d+)$", 1).try_cast("bigint")
    return names.agg(F.max_by(name, number).alias(name))


def threshold_slug(value: float) -> str:
    """0.90 as 0p9."""
    return f"{value:f}".rstrip("0").rstrip(".").replace(".", "p")


def state_group_id(family: Column, step: Column, state: Column) -> Column:
    return F.concat_ws("::", family, step, state)


def episode_seed(base: Column, episode: Column, fixed: bool = False) -> Column:
    """The base seed for all episodes, or moved on by the episode's number."""
    return base if fixed else base + episode
