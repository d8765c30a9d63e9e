"""Preference pairs within a state: win over loss, win beside win, and shorter win over longer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flatten
from .candidates import STATE

OBSERVED, PSEUDO = "observed_win_lose", "pseudo_base_alt_win_length"
ALL_PAIRS = "base-alt-alt"


def allowed(a: Column, b: Column, usable: str = ALL_PAIRS) -> Column:
    """A base with an alternative always; two alternatives only where all pairs are wanted."""
    mixed = ((a == "base") & (b == "alt")) | ((a == "alt") & (b == "base"))
    return mixed | ((a == "alt") & (b == "alt")) if usable == ALL_PAIRS else mixed


def origin(a: Column, b: Column) -> Column:
    return F.when((a == "base") | (b == "base"), "base-alt").otherwise("alt-alt")


def _side(rows: DataFrame, name: str) -> DataFrame:
    """Rows keyed by their state, all else under one name."""
    return rows.select(*STATE, F.struct(*(c for c in rows.columns if c not in STATE)).alias(name))


def _meet(a: DataFrame, b: DataFrame, usable: str) -> DataFrame:
    return _side(a, "chosen").join(_side(b, "rejected"), STATE).where(allowed(F.col("chosen.trajectory_kind"), F.col("rejected.trajectory_kind"), usable))


def _flip(pairs: DataFrame, when: Column) -> DataFrame:
    """chosen and rejected changed over where `when` holds."""
    return pairs.withColumns({"chosen": F.when(when, F.col("rejected")).otherwise(F.col("chosen")), "rejected": F.when(when, F.col("chosen")).otherwise(F.col("rejected"))})


def good_wins(candidates: DataFrame, most_repeats: int) -> DataFrame:
    return candidates.where(F.col("is_win") & (F.col("quality_score") <= most_repeats))


def supported(wins: DataFrame, losses: DataFrame, usable: str = ALL_PAIRS) -> DataFrame:
    """Wins with an allowed loss in their state: a look at which kinds of losses the state has, never a pair."""
    has = losses.groupBy(STATE).agg(F.max(F.col("trajectory_kind") == "base").alias("_base"), F.max(F.col("trajectory_kind") == "alt").alias("_alt"))
    kind = F.col("trajectory_kind")
    ok = ((kind == "base") & F.col("_alt")) | ((kind == "alt") & F.col("_base"))
    return wins.join(has, STATE).where(ok | ((kind == "alt") & F.col("_alt")) if usable == ALL_PAIRS else ok).drop("_base", "_alt")


def win_lose(wins: DataFrame, losses: DataFrame, usable: str = ALL_PAIRS) -> DataFrame:
    """Each win with each allowed loss of its state: state columns, chosen, rejected, pair_semantics."""
    return _meet(wins, losses, usable).withColumn("pair_semantics", F.lit(OBSERVED))


def win_win(wins: DataFrame, usable: str = ALL_PAIRS) -> DataFrame:
    """Each two wins of a state once; chosen is the base, or else the smaller id."""
    rank = lambda c: F.struct(F.when(F.col(f"{c}.trajectory_kind") == "base", 0).otherwise(1), F.col(f"{c}.trajectory_id"))
    return _meet(wins, wins, usable).where(rank("chosen") < rank("rejected")).withColumn("pair_semantics", F.lit("observed_win_win"))


def base_and_alternative(wins: DataFrame, usable: str = ALL_PAIRS) -> DataFrame:
    """The base win of a state with each alternative win; chosen is the one with fewer steps, then the base, then the smaller id."""
    met = _meet(wins.where("trajectory_kind = 'base'"), wins.where("trajectory_kind = 'alt'"), usable)
    pairs = _flip(met, F.col("rejected.post_divergence_call_count") < F.col("chosen.post_divergence_call_count"))
    return pairs.withColumn("pair_semantics", F.lit(PSEUDO))


def pair_rows(pairs: DataFrame, pair_type: str) -> DataFrame:
    """The flat form of pairs."""
    side = lambda s: [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in ("trajectory_id", "trajectory_kind", "action_text", "quality_score", "terminal_progression")]
    kind = origin(F.col("chosen.trajectory_kind"), F.col("rejected.trajectory_kind"))
    return pairs.select(F.lit(pair_type).alias("pair_type"), "pair_semantics", F.col("chosen.task_slug").alias("task_slug"), *STATE, kind.alias("pair_origin"), *side("chosen"), *side("rejected"))


def whole_rows(pairs: DataFrame, pair_type: str, quality: str = "max_same_obs_action", ranking: str | None = None) -> DataFrame:
    """Pairs of candidates.at_states with all their 24 columns: lineage, scores, the chosen side's prompt, and both sides nested.

    ranking: the column of both sides that pairs are ranked by, if any.
    """
    two = lambda c, name=None: [F.col(f"{s}.{c}").alias(f"{s}_{name or c}") for s in ("chosen", "rejected")]
    side = lambda s: F.struct(F.col(f"{s}.response_text").alias("action_text"), F.col(f"{s}.is_win").alias("success"), F.col(f"{s}.terminal_progression").alias("progress")).alias(s)
    ranks = two(ranking, "ranking_score") if ranking else [F.lit(None).cast("double").alias(f"{s}_ranking_score") for s in ("chosen", "rejected")]
    return pairs.select(
        F.lit(pair_type).alias("pair_type"), "pair_semantics", F.col("chosen.task_id").alias("task_id"), *STATE,
        origin(F.col("chosen.trajectory_kind"), F.col("rejected.trajectory_kind")).alias("pair_origin"), *two("seed"), *two("trajectory_id"), *two("trajectory_kind"), *two("source_trace"),
        F.lit(quality).alias("quality_score_name"), *two("quality_score"), F.lit(ranking).cast("string").alias("ranking_score_name"), *ranks, flatten(F.col("chosen.prompt")).alias("prompt"), side("chosen"), side("rejected"),
    )


def balancing_weights(rows: DataFrame, state: list[str] = STATE, weight: str = "pair_weight") -> DataFrame:
    """rows with a weight that gives each state the same sum, and all rows the mean 1.

    Counts per state are aggregated first; the two totals are one row, so no window over all rows is needed.
    """
    per_state = rows.groupBy(state).agg(F.count(F.lit(1)).alias("_n"))
    totals = per_state.agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_states"))
    weighted = per_state.crossJoin(F.broadcast(totals)).select(*state, (F.col("_rows") / (F.col("_states") * F.col("_n"))).alias(weight))
    return rows.join(weighted, state)


def task_stats(candidates: DataFrame, most_repeats: int) -> DataFrame:
    """Counters per task and, with a null task, over all, in one pass."""
    win, good = F.col("is_win"), F.col("is_win") & (F.col("quality_score") <= most_repeats)
    return candidates.rollup("task_slug").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(win).alias("raw_win_candidates"),
        F.count_if(good).alias("quality_filtered_win_candidates"),
        F.count_if(~win).alias("lose_candidates"),
        F.countDistinct(F.when(win, F.col("trajectory_id"))).alias("unique_win_trajectory_count"),
        F.countDistinct(F.when(~win, F.col("trajectory_id"))).alias("unique_lose_trajectory_count"),
        F.countDistinct("family_id").alias("state_group_count"),
    )


def positives(wins: DataFrame) -> DataFrame:
    """One row a win, with the number of wins of its state."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*STATE))
    return wins.select("task_slug", *STATE, "trajectory_id", "trajectory_kind", "action_text", "quality_score", n.alias("state_success_count"))
