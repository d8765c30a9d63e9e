"""Episodes: what a log says of its steps, and typed trajectories from traces with their sibling files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import strip
from ..functions.outcomes import by_finish, of_trace, termination_reason


def action_histogram(steps: DataFrame, episode: str = "trajectory_id", action: str = "action") -> DataFrame:
    """episode and action_frequency, a map from actions to counts; counts combine before the shuffle."""
    counts = steps.where(F.coalesce(action, F.lit("")) != "").groupBy(episode, action).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(episode).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(action, "n")))).alias("action_frequency"))


def rates(steps: DataFrame, episode: str, tokens_in: Column, tokens_out: Column, seconds: Column, requests: Column) -> DataFrame:
    """episode, sums of tokens, requests and seconds, and requests and tokens a minute (0 without time)."""
    found = steps.groupBy(episode).agg(F.sum(tokens_in).alias("input_tokens"), F.sum(tokens_out).alias("output_tokens"), F.sum(requests).alias("request_count"), F.sum(seconds).alias("duration_seconds"))
    a_minute = lambda c: F.when(F.col("duration_seconds") > 0, c * 60.0 / F.col("duration_seconds")).otherwise(0.0)
    return found.withColumns({"rpm": a_minute(F.col("request_count")), "tpm": a_minute(F.col("input_tokens") + F.col("output_tokens"))})


def siblings(traces: DataFrame, steps: DataFrame, logs: DataFrame, on: list[str]) -> DataFrame:
    """Traces that have both a step file and a log of the same folder and stem; the log's columns follow."""
    return traces.join(steps.select(on).distinct(), on, "left_semi").join(logs, on)


def last_known(calls: Column, field: str) -> Column:
    """A field's value in the last call that has one."""
    return F.try_element_at(F.filter(F.transform(calls, lambda c: c[field]), lambda v: v.isNotNull()), F.lit(-1))


def outcome(calls: Column) -> Column:
    """success, progression, reward, done and steps of an episode, from its last call."""
    last = F.try_element_at(calls, F.lit(-1))
    progression, reward = F.coalesce(last["progression"], F.lit(0.0)), F.coalesce(last["reward"], F.lit(0.0))
    return F.struct(
        by_finish(last["won"], progression, last["done"], reward).alias("success"), progression.alias("progression"), reward.alias("reward"),
        F.coalesce(last["done"], F.lit(False)).alias("done"), F.size(calls).alias("num_steps"),
    )


def typed(traces: DataFrame) -> DataFrame:
    """A typed trajectory for each trace: task, seed, whether it won, its score and its steps."""
    none = F.lit(None).cast("string")
    steps = F.transform(
        "calls",
        lambda c, i: F.struct(
            F.coalesce(c["episode_step"], i).alias("step"), F.coalesce(c["observation"], F.lit("")).alias("observation"), strip(c["action"]).alias("action"),
            c["reward"].alias("reward"), c["progression"].alias("progression"), termination_reason(c["won"], c["lost"], F.lit(None).cast("boolean"), c["done"]).alias("termination"),
        ),
    )
    score = F.coalesce(last_known(F.col("calls"), "progression"), last_known(F.col("calls"), "reward"))
    won = of_trace(none, none, none, score, F.exists("calls", lambda c: F.coalesce(c["won"], F.lit(False))))
    return traces.select("episode_id", F.col("task_or_env_params").alias("task_id"), "seed", F.coalesce("trajectory_kind", F.lit("base")).alias("trajectory_kind"), won.alias("won"), score.alias("score"), steps.alias("steps"))


def abort_reasons(episodes: DataFrame, reason: str = "abort_reason") -> DataFrame:
    """Reasons and how often each occurs."""
    named = strip(F.col(reason))
    return episodes.where(named != "").groupBy(named.alias("reason")).agg(F.count(F.lit(1)).alias("occurrences"))


def is_aborted(calls: Column, missing: bool = True, exact: bool = False) -> Column:
    """Any call aborted, with a reason or by its termination; `missing` is the answer for no calls at all. exact: the termination is
    the word itself, not one that begins with it."""
    ended = lambda c: F.lower(strip(c["termination_reason"]))
    bad = lambda c: (ended(c) == "aborted" if exact else ended(c).startswith("aborted")) | (strip(c["extras"]["abort_reason"]) != "")
    return F.when(F.coalesce(F.size(calls), F.lit(-1)) < 0, missing).otherwise(F.coalesce(F.exists(calls, bad), F.lit(False)))


#: Environments whose episodes are branched.
BRANCHED = ("babyai", "babaisai")


def artifacts(traces: DataFrame, steps: DataFrame, logs: DataFrame, on: list[str], environments: tuple[str, ...] = BRANCHED, task: str | None = None, won: Column | None = None) -> DataFrame:
    """Traces with their siblings that may be branched: of these environments, with a task (the wanted one, if given), and, if `won` is given, where it holds."""
    rows = siblings(traces, steps, logs, on).where(F.lower(strip(F.col("env_name"))).isin(*environments) & (strip(F.col("task_or_env_params")) != ""))
    rows = rows if task is None else rows.where(strip(F.col("task_or_env_params")) == task)
    return rows if won is None else rows.where(F.coalesce(won, F.lit(False)))
