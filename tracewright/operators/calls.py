"""Single calls: notices in observations, why a response failed, which actions an environment takes, rows of step files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.casts import strip
from ..functions.text import admissible_commands

#: The words before and behind the action of a notice.
NOTICE_BEGINS, NOTICE_ENDS = "Your previous output did not contain a valid action. Defaulted to action:", "\n\nObservation:\n"
#: What environments take.
ACTIONS = {"babyai": ["turn left", "turn right", "go forward", "pick up", "drop", "toggle"], "babaisai": ["idle", "up", "right", "down", "left"]}
#: Short names of tasks by environment, and the task that stands for none.
TASKS = {
    "babyai": {
        "goto": "BabyAI-MixedTrainLocal-v0/goto", "pickup": "BabyAI-MixedTrainLocal-v0/pickup", "open": "BabyAI-MixedTrainLocal-v0/open", "comp": "BabyAI-MixedTrainLocal-v0/pick_up_seq_go_to",
    },
    "babaisai": {"basic": "babaisai/basic", "room": "babaisai/room", "stop": "babaisai/stop", "flex": "babaisai/flex"},
    "webshop": {"webshop": "webshop"},
}
#: Stop reasons that speak of a limit on length.
LENGTHS = ("length", "max_tokens", "max_output_tokens", "max_completion_tokens")
ACTION_MARK = "Action:"


def split_notice(observation: Column) -> Column:
    """raw, clean and notice; without a notice at the beginning, clean and notice are empty."""
    raw = F.coalesce(observation, F.lit(""))
    found = F.regexp_extract(raw, rf"(?s)^\s*(\Q{NOTICE_BEGINS}\E\s*.*?\Q{NOTICE_ENDS}\E)", 0)
    clean = F.when(found != "", F.substring(raw, F.length(found) + 1, F.length(raw))).otherwise("")
    return F.struct(raw.alias("raw"), clean.alias("clean"), strip(found).alias("notice"))


def with_notice(observation: Column, action: Column) -> Column:
    """The observation behind a notice that names the action taken instead."""
    return F.concat(F.lit(f"\n\n{NOTICE_BEGINS} "), action, F.lit(NOTICE_ENDS), F.coalesce(observation, F.lit("")))


def shown(observation: Column) -> Column:
    """An observation without its notice."""
    parts = split_notice(observation)
    return F.when(parts["notice"] != "", parts["clean"]).otherwise(parts["raw"])


def is_changed(before: Column, after: Column) -> Column:
    """Two observations differ, notices left aside."""
    return shown(before) != shown(after)


def abort_reason(stop: Column, completion: Column) -> Column:
    """Why a response can't be used: its retries ran out, it was cut, or it says nothing; null: it can."""
    why = F.translate(F.lower(strip(stop)), "- ", "__")
    cut = F.lit(False)
    for name in LENGTHS:
        cut = cut | why.contains(name)
    return F.when(why == "error_max_retries", "retry_exhausted").when(cut, "cap_hit").when((why == "empty_response") | (strip(completion) == ""), "invalid_action")


def retryable_failure(kind: Column, status: Column, message: Column, kinds: list[str], statuses: list[int]) -> Column:
    """timeout or connection, of a failure that may pass: by the error's full name, its HTTP status and its message; null: others."""
    said = F.lower(F.coalesce(message, F.lit("")))
    late = F.coalesce(status == 408, F.lit(False)) | F.coalesce(F.lower(kind).contains("timeout"), F.lit(False)) | said.contains("timed out") | said.contains("timeout")
    return F.when(late, "timeout").when(F.coalesce(kind.isin(*kinds), F.lit(False)) | F.coalesce(status.isin(*statuses), F.lit(False)), "connection")


def scored_text(response: Column, action_only: bool = False) -> Column:
    """What of a response is scored: all of it, or from its last action mark on; an error where there is nothing to score."""
    text = strip(response)
    if not action_only:
        return F.when(text != "", text).otherwise(F.raise_error(F.lit("empty response")).cast("string"))
    tail = F.concat(F.lit(ACTION_MARK), F.substring_index(text, ACTION_MARK, -1))
    return F.when(text.contains(ACTION_MARK), tail).otherwise(F.raise_error(F.lit("no action mark in the response")).cast("string"))


def action_space(env: Column, observation: Column) -> Column:
    """The environment's fixed actions; without such, the commands that the observation lists."""
    known = F.lit(None).cast("array<string>")
    for name, actions in ACTIONS.items():
        known = F.when(F.lower(strip(env)) == name, F.array(*(F.lit(a) for a in actions))).otherwise(known)
    return F.coalesce(known, admissible_commands(observation))


def taken(candidate: Column, space: Column, default: Column) -> Column:
    """action and missed: the candidate if the space holds it, else the default."""
    asked = strip(candidate)
    ok = F.array_contains(space, asked)
    return F.struct(F.when(ok, asked).otherwise(default).alias("action"), (~ok).alias("missed"))


def without(actions: Column, excluded: Column) -> Column:
    """Actions but the excluded ones; repeated ones stay repeated."""
    gone = F.transform(F.coalesce(excluded, F.array().cast("array<string>")), lambda a: strip(a))
    return F.filter(actions, lambda a: ~F.array_contains(gone, a))


def task_id(env: str, task: Column) -> Column:
    """A task's full id from its short name; other names stay."""
    full = task
    for short, name in TASKS.get(env, {}).items():
        full = F.when(task == short, name).otherwise(full)
    return full


def field(call: Column, names: list[str], *wanted: str, default: object = None) -> Column:
    """The first of the wanted fields that the call has and that is not null; else the default."""
    return F.coalesce(*(call[w] for w in wanted if w in names), F.lit(default))


def token_usage(call: Column, kind: StructType) -> Column:
    """input, output and total tokens of a call; 0 where it doesn't say."""
    has = "token_usage" in kind.names
    said: Callable[[str], Column] = lambda n: F.coalesce(call["token_usage"][n] if has else F.lit(None).cast("int"), F.lit(0))
    total = F.when(said("total") != 0, said("total")).otherwise(said("input") + said("output"))
    return F.struct(said("input").alias("input"), said("output").alias("output"), total.alias("total"))


def fell_back(call: Column, kind: StructType) -> Column:
    """Another action was taken than the model's."""
    return strip(field(call, kind.names, "action_executed", "action", default="")) != strip(field(call, kind.names, "action_model", "action", default=""))


def step_rows(traces: DataFrame) -> DataFrame:
    """episode_id and the 22 columns of a step file for each call; what a call doesn't have is empty, 0 or false."""
    kind = traces.schema["calls"].dataType.elementType
    names = kind.names
    rows = traces.select("episode_id", F.posexplode("calls").alias("place", "c"))
    c = F.col("c")
    text = lambda *w: field(c, names, *w, default="")
    number = lambda *w: field(c, names, *w, default=0.0).cast("double")
    flag = lambda *w: field(c, names, *w, default=False).cast("boolean")
    tokens = token_usage(c, kind)
    return rows.select(
        "episode_id", F.coalesce(field(c, names, "episode_step", "call_idx"), F.col("place")).cast("int").alias("step"), text("instruction").alias("instruction"), text("observation").alias("observation_pre"),
        text("thought").alias("thought"), text("action_model", "action").alias("action_model"), text("action_executed", "action").alias("action_executed"), text("raw_output").alias("raw_output"),
        text("feedback").alias("feedback"), text("observation_post").alias("observation_post"), flag("obs_changed").alias("obs_changed"), number("reward").alias("reward"),
        number("progression", "reward").alias("progression"), flag("terminated", "done").alias("terminated"), flag("truncated").alias("truncated"), flag("done").alias("done"),
        text("termination_reason").alias("termination_reason"), flag("action_defaulted").alias("action_defaulted"), tokens["input"].alias("input_tokens"), tokens["output"].alias("output_tokens"),
        number("step_wall_time_sec").alias("step_wall_time_sec"), flag("won").alias("won"), flag("lost").alias("lost"),
    )
