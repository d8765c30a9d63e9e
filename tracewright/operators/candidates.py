"""Candidates: trajectories judged at a state where they part from their base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import strip
from ..functions.text import messages, task_slug
from ..sources.traces import resolved

STATE = ["family_id", "divergence_step", "state_key"]


def eligible_branches(branches: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Branches that were generated and replayed, at a step from 0 on, with a state; of allowed families only, if given."""
    kept = branches.where((F.col("status") == "generated") & F.coalesce("replay_success", F.lit(False)) & (F.col("divergence_step") >= 0) & (F.trim(F.coalesce("state_key", F.lit(""))) != ""))
    return kept.join(families, "family_id", "left_semi") if families is not None else kept


def normal_branches(branches: DataFrame) -> DataFrame:
    """Branches that the artifact files take: no status counts as generated, replays don't matter, a base must be named."""
    status = F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("generated"))
    return branches.where((status == "generated") & (F.trim(F.coalesce("base_traj_id", F.lit(""))) != "")).withColumn("family_id", F.coalesce("family_id", "base_traj_id"))


def first_families(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` family ids in order; all for 0."""
    every = rows.select("family_id").distinct()
    return every.orderBy("family_id").limit(most) if most > 0 else every


def longest_repeat(steps: DataFrame, trajectory: str = "trajectory_id", observation: str = "obs_pre", action: str = "action", order: str = "step") -> DataFrame:
    """trajectory and max_run, the most consecutive steps with one observation and action."""
    w = Window.partitionBy(trajectory).orderBy(order)
    key = F.struct(F.coalesce(F.col(observation).cast("string"), F.lit("")), F.coalesce(F.col(action), F.lit("")))
    new = F.coalesce((F.lag(key).over(w) != key).cast("int"), F.lit(1))
    runs = steps.select(trajectory, order, new.alias("new")).withColumn("run", F.sum("new").over(w))
    # the cumulative sum orders rows of one trajectory only; the counts combine before the shuffle
    return runs.groupBy(trajectory, "run").agg(F.count(F.lit(1)).alias("n")).groupBy(trajectory).agg(F.max("n").alias("max_run"))


def candidates(trajectories: DataFrame, repeats: DataFrame, is_win: Column) -> DataFrame:
    """The candidate relation of trajectories without a branch index: all of a family part at its first step, in one state.

    at_states() has the candidates of branches that part later.
    """
    rows = trajectories.join(repeats, "trajectory_id", "left")
    return rows.select(
        "family_id", "trajectory_id", "trajectory_kind", F.lit(0).alias("divergence_step"), F.col("family_id").cast("string").alias("state_key"), "task_slug", "action_text",
        "terminal_progression", "terminal_reward", F.coalesce("max_run", F.lit(0)).alias("quality_score"), is_win.alias("is_win"), F.col("n_steps").alias("post_divergence_call_count"), "ref_logprob",
    )


def prompt_of(call: Column) -> Column:
    """A call's messages; without any, its instruction and observation, and no messages where one of the two is empty."""
    own = F.coalesce(messages(call["extras"]["balrog_raw"]["messages"]), F.array().cast("array<struct<role:string,content:string>>"))
    asked, seen = strip(call["instruction"]), strip(call["observation"])
    shown = F.concat(F.lit("Current Observation:\n"), seen, F.lit("\n\nYour response should use the following format:\n\nThought: <your thoughts>\nAction: <your next action>"))
    user = lambda text: F.struct(F.lit("user").alias("role"), text.alias("content"))
    return F.when(F.size(own) > 0, own).when((asked != "") & (seen != ""), F.array(user(asked), user(shown))).otherwise(own)


def response_of(call: Column) -> Column:
    """A call's raw completion unless it is the action alone; else thought and action, or the action, or ''."""
    raw = strip(F.coalesce(F.nullif(call["extras"]["balrog_raw"]["response"]["raw_completion"], F.lit("")), call["raw_output"]))
    action, thought = strip(call["action"]), strip(call["thought"])
    return (
        F.when((raw != "") & (raw != action), raw)
        .when(thought != "", F.concat(F.lit("Thought: "), thought, F.lit("\n\nAction: "), action))
        .when(action != "", F.concat(F.lit("Action: "), action))
        .otherwise(raw)
    )


def repeats_in(calls: Column) -> Column:
    """The most consecutive calls with one observation and action; longest_repeat() for an array."""
    start = F.struct(F.lit(None).cast("struct<o:string,a:string>").alias("k"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, c: Column) -> Column:
        k = F.when(c.isNotNull(), F.struct(F.coalesce(c["observation"], F.lit("")).alias("o"), F.coalesce(c["action"], F.lit("")).alias("a")))
        run = F.when(c.isNull(), 0).when(k == s["k"], s["run"] + 1).otherwise(1)
        return F.struct(k.alias("k"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(calls, start, step)["best"]


HELD = ["trace_path", "task_or_env_params", "seed", "calls"]


def _taken(traces: DataFrame, places: DataFrame) -> DataFrame:
    """Of each place (trace_path, STATE, trajectory_id) what its trace says there, without the calls; or an error.

    A trace meets all its places at once, so that its calls move once at most, however many states it stands in.
    """
    at = places.groupBy("trace_path").agg(F.collect_list(F.struct(*STATE, "trajectory_id")).alias("_at"))
    met = traces.select(*HELD).join(at, "trace_path").withColumns({"_size": F.coalesce(F.size("calls"), F.lit(0)), "_last": F.try_element_at("calls", F.lit(-1)), "_runs": repeats_in(F.col("calls"))})
    each = met.withColumn("_a", F.explode("_at")).select("*", "_a.*").withColumn("_call", F.try_element_at("calls", F.col("divergence_step").cast("int") + 1))
    size, d, call, last = F.col("_size"), F.col("divergence_step"), F.col("_call"), F.col("_last")
    fail = lambda what: F.raise_error(F.concat(F.lit(what), F.col("trace_path"))).cast("boolean")
    sound = F.when(size == 0, fail("no calls in ")).when((d < 0) | (d >= size), fail("divergence_step is out of range for ")).otherwise(True)
    number = lambda name: F.coalesce(last[name], F.lit(0.0)).alias(f"terminal_{name}")
    return each.where(sound).select(
        *STATE, "trajectory_id", F.col("task_or_env_params").alias("task_id"), task_slug(F.col("task_or_env_params")).alias("task_slug"), F.coalesce("seed", F.lit(-1)).cast("long").alias("seed"),
        prompt_of(call).alias("prompt"), response_of(call).alias("response_text"), strip(call["action"]).alias("action_text"), number("progression"), number("reward"), F.coalesce(last["done"], F.lit(False)).alias("terminal_done"),
        F.col("_runs").alias("quality_score"), (size - d).alias("post_divergence_call_count"), F.col("trace_path").alias("source_trace"),
    )


def _judged(rows: DataFrame, kind: str, is_win: Column) -> DataFrame:
    """Candidates of a kind, or an error: each has a prompt and a response."""
    fail = lambda what: F.raise_error(F.concat(F.lit(what), F.col("source_trace"))).cast("boolean")
    sound = F.when(F.size("prompt") <= 0, fail("no prompt at divergence step of ")).when(F.col("response_text") == "", fail("no response at divergence step of ")).otherwise(True)
    found = rows.where(sound).withColumn("trajectory_kind", F.lit(kind))
    own = ["trajectory_id", "trajectory_kind", "task_id", "task_slug", "seed", "prompt", "response_text", "action_text", "terminal_progression", "terminal_reward", "terminal_done", "quality_score", "post_divergence_call_count", "source_trace"]
    return found.select(*STATE, *own).withColumn("is_win", is_win)


def at_states(branches: DataFrame, bases: DataFrame, alternatives: DataFrame, is_win: Column, families: DataFrame | None = None) -> DataFrame:
    """The candidates of each state (family, step, state key) of the eligible branches: its base once, and each branch.

    Both stand at calls[divergence_step] of their own trace, on the base's prompt. branches: alt_traj_id, base_traj_id,
    divergence_step, state_key, status, replay_success, output_trace; bases and alternatives: traces. Of base traces with
    one id the last by path counts; branches without a base trace are left out. A trace without calls, a step out of range
    and an empty prompt or response are errors, and so is a branch without a single trace. is_win: over the columns made here.
    """
    named = branches.withColumns({"family_id": strip(F.col("base_traj_id")), "state_key": strip(F.col("state_key")), "alt_traj_id": strip(F.col("alt_traj_id"))})
    last = bases.groupBy(F.col("episode_id").alias("family_id")).agg(F.max("trace_path").alias("trace_path"))
    rows = eligible_branches(named, families).join(last.select("family_id"), "family_id", "left_semi").select(*STATE, "alt_traj_id", "output_trace")
    at_base = _judged(_taken(bases, rows.select(STATE).distinct().join(last, "family_id").withColumn("trajectory_id", F.col("family_id"))), "base", is_win)
    # branches without an id have no trace, but their state has its base
    placed = resolved(rows.where("alt_traj_id <> ''"), alternatives.select("trace_path", "episode_id")).select(*STATE, F.col("alt_traj_id").alias("trajectory_id"), "trace_path")
    own = _taken(alternatives, placed).drop("prompt").join(at_base.select(*STATE, "prompt"), STATE)
    return at_base.unionByName(_judged(own, "alt", is_win))


def quality(rows: DataFrame, name: str = "max_same_obs_action", **more: str) -> DataFrame:
    """trajectory and the quality score of that name; a name that there isn't is an error."""
    scores = {"max_same_obs_action": longest_repeat}
    if name not in scores:
        raise ValueError(f"no quality score {name}")
    return scores[name](rows, **more)
