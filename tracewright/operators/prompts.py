"""Prompts with a bounded history: observations and actions woven by position, each with a limit of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sliding import windows

#: How a prompt names what it shows.
NOW, EARLIER, PLAN = "Current Observation:", "Observation:", "Previous plan:"
EVENT = ["seen", "said", "now", "reasoning"]


def woven(observations: DataFrame, actions: DataFrame, group: str, step: str) -> DataFrame:
    """Events of two streams, in order of (step, part): what is seen at a step, then what is done there.

    observations: said, now (what only the current observation shows, may be null); actions: said, reasoning (null without).
    """
    none = F.lit(None).cast("string")
    seen = observations.select(group, step, F.lit(0).alias("part"), F.lit(True).alias("seen"), F.coalesce("said", F.lit("")).alias("said"), F.col("now").cast("string").alias("now"), none.alias("reasoning"))
    done = actions.select(group, step, F.lit(1).alias("part"), F.lit(False).alias("seen"), F.coalesce("said", F.lit("")).alias("said"), none.alias("now"), F.col("reasoning").cast("string").alias("reasoning"))
    return seen.unionByName(done)


def _last(places: Column, most: int) -> Column:
    return F.slice(places, F.greatest(F.size(places) - most + 1, F.lit(1)), F.lit(most)) if most > 0 else F.slice(places, F.lit(1), F.lit(0))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages_of(events: Column, instruction: Column, texts: int, reasonings: int) -> Column:
    """The messages of a prompt from its last events, the last of which is the current observation."""
    places = F.sequence(F.lit(1), F.size(events))
    at = lambda i: F.element_at(events, i)
    shown = _last(F.filter(places, lambda i: at(i)["seen"]), texts)
    thought = _last(F.filter(places, lambda i: ~at(i)["seen"] & at(i)["reasoning"].isNotNull()), reasonings)

    def one(i: Column) -> Column:
        before = F.try_element_at(events, F.when(i > 1, i - 1))
        done = F.when(F.array_contains(thought, i - 1), F.concat(F.lit(f"{PLAN}\n"), before["reasoning"])).otherwise(before["said"])
        is_now = i == F.size(events)
        parts = F.array(F.when(is_now, NOW).otherwise(EARLIER), F.when(is_now, F.nullif(at(i)["now"], F.lit(""))), at(i)["said"])
        user = _message("user", F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n"))
        return F.when(F.coalesce(~before["seen"], F.lit(False)), F.array(_message("assistant", done), user)).otherwise(F.array(user))

    told = F.when(F.coalesce(instruction, F.lit("")) != "", F.array(_message("user", instruction))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return F.concat(told, F.flatten(F.transform(shown, one)))


def prompts(events: DataFrame, instruction: Column, group: str, step: str, texts: int = 16, reasonings: int = 1, block: int = 8_192) -> DataFrame:
    """group, step and messages of the prompt at each observation of woven() events.

    It has the instruction, if any; the last `texts` observations, each after the action right before it, if one is; and of the
    last `reasonings` actions that have one, the reasoning instead of the action. What it can see are the last 2 * texts events
    (two at least). instruction: over the events' columns. No group is one task.
    """
    recent = windows(events, group, [step, "part"], 2 * max(texts, 1), EVENT, "recent", block)
    found = recent.where("seen").select(group, step, messages_of(F.col("recent"), instruction, texts, reasonings).alias("messages"))
    return found
