"""Whole pair datasets for a method, from the candidate relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import divpo, pairs, targets
from ..operators.candidates import STATE
from .stages import PairConfig


def win_lose_rows(candidates: DataFrame, config: PairConfig) -> DataFrame:
    """Observed pairs and, if wanted, base-and-alternative ones, weighted by state."""
    wins, losses = pairs.good_wins(candidates, config.most_repeats), candidates.where("not is_win")
    rows = pairs.pair_rows(pairs.win_lose(wins, losses, config.usable), "win_lose")
    if config.pseudo_pairs:
        rows = rows.unionByName(pairs.pair_rows(pairs.base_and_alternative(wins, config.usable), "win_lose"))
    return pairs.balancing_weights(rows)


def win_win_rows(candidates: DataFrame, config: PairConfig) -> DataFrame:
    """Pairs of wins with soft targets relative to the reference, weighted by state."""
    wins = targets.state_targets(pairs.good_wins(candidates, config.most_repeats), config.eta)
    met = pairs.win_win(wins, config.usable)
    side = lambda c: (F.col(f"chosen.{c}"), F.col(f"rejected.{c}"))
    margin = targets.reference_margin(*side("state_prob"), *side("ref_logprob"))
    rows = met.select(*STATE, F.col("chosen.trajectory_id").alias("chosen_trajectory_id"), F.col("rejected.trajectory_id").alias("rejected_trajectory_id"), margin.alias("target_margin"))
    return pairs.balancing_weights(rows.withColumn("chosen_target_prob", targets.sigmoid(F.col("target_margin") * config.beta)))


def divpo_rows(candidates: DataFrame, config: PairConfig, scope: str = "task") -> DataFrame:
    """One pair a state; all wins take part, however often they repeat themselves."""
    scored = divpo.with_diversity(candidates, scope)
    wins, losses = scored.where("is_win"), scored.where("not is_win")
    every = pairs.win_lose(divpo.leading(wins, True), divpo.leading(losses, False), config.usable)  # four pairs a state at most
    if config.pseudo_pairs:
        every = every.unionByName(pairs.base_and_alternative(wins, config.usable))
    return divpo.select(every)
