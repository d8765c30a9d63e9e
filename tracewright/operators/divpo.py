"""Diversity-selected pairs: in each state the rarest win over the most common loss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import STATE


def action_counts(candidates: DataFrame, scope: list[str]) -> DataFrame:
    """scope, action_text, action_count."""
    return candidates.groupBy(*scope, "action_text").agg(F.count(F.lit(1)).alias("action_count"))


def with_diversity(candidates: DataFrame, scope: str = "task") -> DataFrame:
    """candidates with action_count and diversity_score, one over how many of the task (or state) take the action."""
    keys = ["task_slug"] if scope == "task" else STATE
    scored = candidates.join(action_counts(candidates, keys), [*keys, "action_text"])
    return scored.withColumn("diversity_score", 1.0 / F.greatest("action_count", F.lit(1)))


def leading(side: DataFrame, highest: bool) -> DataFrame:
    """Of each state and kind the one candidate that any selected pair of them has: with the highest (or lowest) score, then the smallest id.

    What a pair is ranked by falls apart into its two sides, so no others need to meet. The least combines before the shuffle.
    """
    rank = F.struct((-F.col("diversity_score") if highest else F.col("diversity_score")).alias("s"), F.col("trajectory_id").alias("i"))
    rest = [c for c in side.columns if c not in (*STATE, "trajectory_kind")]
    return side.groupBy(*STATE, "trajectory_kind").agg(F.min_by(F.struct(*rest), rank).alias("_c")).select(*STATE, "trajectory_kind", "_c.*")


def select(pairs: DataFrame) -> DataFrame:
    """One pair a state: the highest score chosen, the lowest rejected, then base before alternative and smaller ids; of equal
    pairs the observed one. The least of a struct combines before the shuffle: no sort, no window."""
    tie = lambda s: F.struct(F.when(F.col(f"{s}.trajectory_kind") == "base", 0).otherwise(1).alias("k"), F.col(f"{s}.trajectory_id").alias("i"))
    rank = F.struct(
        (-F.col("chosen.diversity_score")).alias("a"), F.col("rejected.diversity_score").alias("b"), tie("chosen").alias("c"), tie("rejected").alias("d"),
        F.when(F.col("pair_semantics").startswith("observed"), 0).otherwise(1).alias("e"),
    )
    best: Column = F.min_by(F.struct("chosen", "rejected", "pair_semantics"), rank)
    return pairs.groupBy(STATE).agg(best.alias("p")).select(*STATE, "p.chosen", "p.rejected", "p.pair_semantics")


def with_logprob(candidates: DataFrame, scored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """candidates with diversity_score, the negative log probability of their response; `scored` gives rows a column logprob,
    as plans.scoring.scored_once does. Each different (trajectory, step, response) is scored once."""
    key = ["trajectory_id", "divergence_step", "response_text"]
    found = scored(candidates.select(key).distinct()).select(*(F.col(c).alias(f"_{c}") for c in key), "logprob")
    met = candidates.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]).drop(*(f"_{c}" for c in key))
    return met.withColumn("diversity_score", -F.col("logprob")).drop("logprob")
