"""Counters of pair datasets, from how many candidates of each kind a state has: no pair is made to be counted.

A state's wins and losses fall into those of its base and those of alternatives; which kinds may meet is a matter of the two kinds
alone, so numbers of pairs are products of these counts. Counters come per task and, with a null task, over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .candidates import STATE
from .pairs import ALL_PAIRS


def narrow(candidates: DataFrame) -> DataFrame:
    """What counters need of candidates, written once: no prompts or responses, and what made them runs a single time."""
    own = [*STATE, "trajectory_id", "trajectory_kind", "task_slug", "is_win", "quality_score", "post_divergence_call_count"]
    return kept(candidates.select(*(c for c in own if c in candidates.columns)))


def state_counts(candidates: DataFrame, most_repeats: int | None) -> DataFrame:
    """STATE, task_slug and, of each state: wins, those of quality (wb of the base, wa of alternatives) and losses (lb, la).

    most_repeats: None takes every win. The task of a state is its base's, or the least of its candidates'.
    """
    win, base = F.col("is_win"), F.col("trajectory_kind") == "base"
    good = win & (F.col("quality_score") <= most_repeats) if most_repeats is not None else win
    count = lambda c: F.count_if(c)
    return candidates.groupBy(STATE).agg(
        F.coalesce(F.min(F.when(base, F.col("task_slug"))), F.min("task_slug")).alias("task_slug"), F.count(F.lit(1)).alias("candidates"), count(win).alias("raw_wins"),
        count(good & base).alias("wb"), count(good & ~base).alias("wa"), count(~win & base).alias("lb"), count(~win & ~base).alias("la"),
    )


def with_pairs(states: DataFrame, usable: str = ALL_PAIRS) -> DataFrame:
    """State counts with the numbers of wins that have a loss to meet (sb, sa) and of pairs: observed, pseudo, of supported wins, of all good wins."""
    wb, wa, lb, la = (F.col(c) for c in ("wb", "wa", "lb", "la"))
    every = usable == ALL_PAIRS
    sb = F.when(la > 0, wb).otherwise(0)
    sa = F.when((lb > 0) | (la > 0), wa).otherwise(0) if every else F.when(lb > 0, wa).otherwise(0)
    observed = wb * la + wa * lb + (wa * la if every else F.lit(0))
    of = lambda b, a: (b * a + (F.floor(a * (a - 1) / 2) if every else F.lit(0))).cast("bigint")
    return states.withColumns({"sb": sb.cast("bigint"), "sa": sa.cast("bigint"), "observed": observed, "pseudo": F.when(wb > 0, wa).otherwise(0).cast("bigint")}).withColumns(
        {"supported_win_win": of(F.col("sb"), F.col("sa")), "win_win": of(wb, wa)}
    )


def _unique(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """_task and, for each flag, the number of different trajectories it holds for; counts per task, and over all, combine before the shuffle."""
    marked = rows.select("_task", "trajectory_id", *(c.alias(n) for n, c in flags.items()))
    each = marked.groupBy("_task", "trajectory_id").agg(*(F.max(n).alias(n) for n in flags))
    return each.groupBy("_task").agg(*(F.count_if(n).alias(n) for n in flags))


def _rollup(states: DataFrame, sums: dict[str, Column]) -> DataFrame:
    return states.rollup("task_slug").agg(F.count(F.lit(1)).alias("state_group_count"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in sums.items()))


def _met(candidates: DataFrame, states: DataFrame) -> DataFrame:
    """Candidates beside their state's counts; a state is one row on that side."""
    return candidates.drop("task_slug").join(states, STATE).withColumn("_task", F.explode(F.array(F.col("task_slug"), F.lit(None).cast("string"))))


def _joined(counters: DataFrame, unique: DataFrame, names: list[str]) -> DataFrame:
    found = counters.join(unique, F.col("task_slug").eqNullSafe(F.col("_task")), "left").drop("_task")
    return found.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def filtered_statistics(candidates: DataFrame, most_repeats: int, usable: str = ALL_PAIRS, pseudo: bool = False) -> DataFrame:
    """The counters of filtered pairs per task and over all (null task): states, wins raw, of quality and supported, losses, rows of
    each kind, and different trajectories among wins, losses and rejected sides.

    A state has one base. pseudo: pairs of the base's win with each alternative win count among the rows and trajectories.
    """
    candidates = narrow(candidates)
    states = with_pairs(state_counts(candidates, most_repeats), usable)
    extra = F.col("pseudo") if pseudo else F.lit(0)
    counters = _rollup(states, {
        "raw_win_candidates": F.col("raw_wins"), "quality_filtered_win_candidates": F.col("wb") + F.col("wa"), "support_filtered_win_candidates": F.col("sb") + F.col("sa"), "lose_candidates": F.col("lb") + F.col("la"),
        "win_lose_rows": F.col("observed") + extra, "observed_win_lose_rows": F.col("observed"), "pseudo_win_lose_rows": extra, "win_win_rows": F.col("supported_win_win"),
    })
    base, every = F.col("trajectory_kind") == "base", usable == ALL_PAIRS
    good = F.col("is_win") & (F.col("quality_score") <= most_repeats)
    supported = good & F.when(base, F.col("la") > 0).otherwise((F.col("lb") > 0) | ((F.col("la") > 0) if every else F.lit(False)))
    met = ~F.col("is_win") & F.when(base, F.col("wa") > 0).otherwise((F.col("wb") > 0) | ((F.col("wa") > 0) if every else F.lit(False)))
    rows = _met(candidates, states)
    flags = {"unique_win_trajectory_count": supported, "unique_lose_trajectory_count": met, "unique_rejected_trajectory_count": met}
    if pseudo:
        calls = candidates.where("trajectory_kind = 'base'").where(F.col("is_win") & (F.col("quality_score") <= most_repeats)).groupBy(STATE).agg(F.min("post_divergence_call_count").alias("_base_calls"))
        reach = candidates.where("trajectory_kind = 'alt'").where(F.col("is_win") & (F.col("quality_score") <= most_repeats)).groupBy(STATE).agg(F.min("post_divergence_call_count").alias("_least_calls"))
        rows = rows.join(calls, STATE, "left").join(reach, STATE, "left")
        both = good & (F.col("wb") > 0) & (F.col("wa") > 0)
        loses = both & F.when(base, F.col("_least_calls") < F.col("_base_calls")).otherwise(F.col("post_divergence_call_count") >= F.col("_base_calls"))
        flags["unique_win_trajectory_count"] = supported | both
        flags["unique_rejected_trajectory_count"] = met | loses
    no = {n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}
    return _joined(counters, _unique(rows, no), list(flags))


def balanced_statistics(candidates: DataFrame, most_repeats: int, usable: str = ALL_PAIRS) -> DataFrame:
    """The counters of the balanced dataset: rows and states of each split (wins over losses, pairs of wins, positives), eligible
    wins, and different trajectories among wins, losses and positives. Pairs of wins take every win of quality."""
    candidates = narrow(candidates)
    states = with_pairs(state_counts(candidates, most_repeats), usable)
    good, pairs = F.col("wb") + F.col("wa"), F.col("win_win") > 0
    one = lambda c: F.when(c, 1).otherwise(0)
    counters = _rollup(states, {
        "raw_win_candidates": F.col("raw_wins"), "quality_filtered_win_candidates": good, "lose_candidates": F.col("lb") + F.col("la"), "win_lose_eligible_wins": F.col("sb") + F.col("sa"),
        "win_win_eligible_wins": F.when(pairs, good).otherwise(0), "win_lose_rows": F.col("observed"), "win_win_rows": F.col("win_win"), "positive_rows": good,
        "win_lose_state_count": one(F.col("observed") > 0), "win_win_state_count": one(pairs), "positive_state_count": one(good > 0), "positive_eligible_wins": good,
    })
    base, every = F.col("trajectory_kind") == "base", usable == ALL_PAIRS
    is_good = F.col("is_win") & (F.col("quality_score") <= most_repeats)
    met = ~F.col("is_win") & F.when(base, F.col("wa") > 0).otherwise((F.col("wb") > 0) | ((F.col("wa") > 0) if every else F.lit(False)))
    flags = {"unique_win_trajectory_count": is_good, "unique_lose_trajectory_count": met, "unique_positive_trajectory_count": is_good}
    return _joined(counters, _unique(_met(candidates, states), {n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}), list(flags))


def divpo_statistics(candidates: DataFrame, selected: DataFrame, usable: str = ALL_PAIRS, pseudo: bool = False) -> DataFrame:
    """The counters of selected pairs: states, those with any pair, wins and losses, pairs that could be taken, and of those
    that were (divpo.select's rows) how many of each kind and how many different trajectories on each side."""
    states = with_pairs(state_counts(candidates, None), usable)
    extra = F.col("pseudo") if pseudo else F.lit(0)
    counters = _rollup(states, {
        "eligible_state_group_count": F.when(F.col("observed") + extra > 0, 1).otherwise(0), "raw_win_candidates": F.col("raw_wins"), "raw_lose_candidates": F.col("lb") + F.col("la"),
        "observed_pair_candidate_count": F.col("observed"), "pseudo_pair_candidate_count": extra,
    })
    taken = selected.join(states.select(*STATE, "task_slug"), STATE).rollup("task_slug").agg(
        F.count_if(F.col("pair_semantics").startswith("observed")).alias("selected_observed_row_count"), F.count_if(~F.col("pair_semantics").startswith("observed")).alias("selected_pseudo_row_count"), F.count(F.lit(1)).alias("output_rows"),
        F.countDistinct("chosen.trajectory_id").alias("unique_chosen_trajectory_count"), F.countDistinct("rejected.trajectory_id").alias("unique_rejected_trajectory_count"),
    ).withColumnRenamed("task_slug", "_task")
    return _joined(counters, taken, [c for c in taken.columns if c != "_task"])
