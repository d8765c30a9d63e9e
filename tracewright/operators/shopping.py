"""Metrics of shopping episodes: sessions, purchases, ways by four keys, and their summary."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.casts import strip
from ..functions.text import type_signature
from .diversity import strategy_summary

#: What two episodes may be alike in.
KEYS = ["purchase_signature", "action_trace", "action_type_trace", "purchase_action_type_trace"]


def session_id(session: Column, episode: Column) -> Column:
    """The session; without one, the hundred that the episode's number is in."""
    return F.coalesce(session.cast("bigint"), F.floor(episode / 100).cast("bigint"))


def in_sessions(traces: DataFrame, sessions: list[int] | None = None, kind: str | None = None, env: str = "webshop") -> DataFrame:
    """Traces of the environment, of these sessions and of this kind (base or alt) where given."""
    rows = traces.where(F.col("env_name") == env)
    rows = rows if sessions is None else rows.where(session_id(F.col("session_id"), F.col("episode_idx")).isin(sessions))
    return rows if kind is None else rows.where(F.coalesce("trajectory_kind", F.lit("base")) == kind)


def is_terminal_or_paid(reward: Column, *ends: Column) -> Column:
    """A step that pays or ends the episode, by any of the flags."""
    found = F.coalesce(reward > 0, F.lit(False))
    for e in ends:
        found = found | F.coalesce(e, F.lit(False))
    return found


def purchase(own: Column, of_calls: Column) -> Column:
    """The episode's signature; without one, that of the last call that has one; else ''."""
    some = F.filter(F.transform(of_calls, strip), lambda s: s != "")
    return F.coalesce(F.nullif(strip(own), F.lit("")), F.try_element_at(some, F.lit(-1)), F.lit(""))


def _compact(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def _one_way(signature: str | None) -> str:
    text = (signature or "").strip()
    try:
        said = json.loads(text)
    except ValueError:
        return text
    item = str(said.get("asin") or "").strip().upper() if isinstance(said, dict) else ""
    options = said.get("options") if item else None
    return _compact({"asin": item, "options": options if isinstance(options, dict) else {}}) if item else text


@F.pandas_udf(StringType())
def canonical_purchase(signature: pd.Series) -> pd.Series:
    """One way to write a signature: upper-case item and sorted options as compact JSON; what is no such object stays."""
    return signature.map(_one_way)


@F.pandas_udf(StringType())
def _trace_json(actions: pd.Series) -> pd.Series:
    return actions.map(lambda a: json.dumps(list(a)))


@F.pandas_udf(StringType())
def _both_json(kinds: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([_compact({"action_type_trace": k, "purchase_signature": s}) for k, s in zip(kinds, signature, strict=True)])


def strategy_key(actions: Column, signature: Column, by: str) -> Column:
    """The way that an episode took, by one of KEYS. A purchase with its kinds of actions needs a signature: an error without."""
    if by == "action_trace":
        return _trace_json(actions)
    if by == "action_type_trace":
        return type_signature(actions)
    if by == "purchase_action_type_trace":
        needed = F.when(signature != "", signature).otherwise(F.raise_error(F.lit("no purchase signature")).cast("string"))
        return _both_json(type_signature(actions), canonical_purchase(needed))
    if by != "purchase_signature":
        raise ValueError(f"by must be one of {KEYS}")
    return F.when(signature != "", signature).otherwise(_trace_json(actions))


def unsigned(episodes: DataFrame, most: int = 5) -> list[str]:
    """The first few successes without a purchase signature: a report, so its length is bounded."""
    rows = episodes.where(F.col("is_success") & (F.col("signature") == "")).orderBy("trajectory_id").limit(most)
    return [r["trajectory_id"] for r in rows.select("trajectory_id").collect()]


def signed(episodes: DataFrame) -> DataFrame:
    """episodes, or an error that counts the successes without a purchase signature and names the first few."""
    if names := unsigned(episodes):
        n = episodes.where(F.col("is_success") & (F.col("signature") == "")).count()
        raise ValueError(f"{n} successes without a purchase signature: {', '.join(names)}")
    return episodes


def run_summary(episodes: DataFrame, by: list[str], k: int) -> DataFrame:
    """strategy_summary with success_at_k (a success in the first k episodes by order `at`) and successes without a signature."""
    first = episodes.groupBy(*by).agg(F.max(F.col("is_success") & (F.col("at") < k)).cast("int").alias("success_at_k"), F.count_if(F.col("is_success") & (F.col("signature") == "")).alias("missing_signatures"))
    return strategy_summary(episodes, by).join(first, by)


def histogram(episodes: DataFrame, by: list[str], key: str = "strategy") -> DataFrame:
    """How often each way leads to success."""
    return episodes.where("is_success").groupBy(*by, key).agg(F.count(F.lit(1)).alias("count"))
