"""Soft targets from reference log-probabilities, and the preference losses, as column expressions."""

from __future__ import annotations

import math
from sys import float_info

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .candidates import STATE


def sigmoid(x: Column) -> Column:
    """Stable for large |x|."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def neg_log_sigmoid(x: Column) -> Column:
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def state_targets(wins: DataFrame, eta: float, logprob: str = "ref_logprob") -> DataFrame:
    """wins with state_prob, the softmax of (1 - eta) * logprob over the wins of a state; uniform for eta = 1."""
    if not 0.0 <= eta <= 1.0:
        raise ValueError("eta must be from 0 to 1")
    w = Window.partitionBy(*STATE)
    if eta == 1.0:
        return wins.withColumn("state_prob", 1.0 / F.count(F.lit(1)).over(w))
    scaled = F.lit(1.0 - eta) * F.col(logprob)
    raised = wins.withColumn("_e", F.greatest(F.exp(scaled - F.max(scaled).over(w)), F.lit(float_info.min)))
    return raised.withColumn("state_prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def pair_target(chosen: Column, rejected: Column) -> Column:
    return chosen / (chosen + rejected)


def reference_margin(chosen: Column, rejected: Column, chosen_logprob: Column, rejected_logprob: Column) -> Column:
    """How far the target's log odds go beyond the reference's."""
    return (F.log(chosen) - F.log(rejected)) - (chosen_logprob - rejected_logprob)


def loss_terms(beta: float = 0.1, rk_alpha: float = math.log(3.0), davidson_nu: float = 1.0) -> dict[str, Column]:
    """Losses of a row with gap (chosen less rejected reward), is_tie and target."""
    gap = F.col("gap")
    d, tie = gap * beta, F.col("is_tie")
    log_2nu = math.log(2.0 * davidson_nu)
    middle = F.lit(log_2nu) - d / 2
    top = F.greatest(F.lit(0.0), -d, middle)
    davidson = top + F.log(F.exp(-top) + F.exp(-d - top) + F.exp(middle - top))
    return {
        "dpo": neg_log_sigmoid(d),
        "rao_kupper": F.when(tie, -math.log(math.expm1(2 * rk_alpha)) + neg_log_sigmoid(-d - rk_alpha) + neg_log_sigmoid(d - rk_alpha)).otherwise(neg_log_sigmoid(d - rk_alpha)),
        "davidson": F.when(tie, davidson - middle).otherwise(davidson),
        "soft_target": F.col("target") * neg_log_sigmoid(d) + (1 - F.col("target")) * neg_log_sigmoid(-d),
    }


def balanced_loss(rows: DataFrame, beta: float = 0.1) -> DataFrame:
    """Weighted preference loss over plain rows plus weighted soft loss over ties; a part without rows counts 0."""
    terms = loss_terms(beta)
    part = lambda when, loss: F.coalesce(F.avg(F.when(when, F.col("weight") * loss)), F.lit(0.0))
    return rows.agg(part(~F.col("is_tie"), terms["dpo"]).alias("pref_loss"), part(F.col("is_tie"), terms["soft_target"]).alias("div_loss")).withColumn("loss", F.col("pref_loss") + F.col("div_loss"))


def gap_loss(rows: DataFrame, beta: float = 0.1, weight: float = 1.0, floor_weight: float = 1.0, floor: bool = False) -> DataFrame:
    """Preference loss plus a pull of the ties' two rewards together; with `floor`, upwards to the plain rows' mean reward."""
    tie = F.col("is_tie")
    pref = F.coalesce(F.avg(F.when(~tie, loss_terms(beta)["dpo"])), F.lit(0.0))
    match = F.coalesce(F.avg(F.when(tie, F.pow("gap", F.lit(2.0)))), F.lit(0.0))
    if not floor:
        return rows.agg(pref.alias("pref_loss"), match.alias("div_loss")).withColumn("loss", F.col("pref_loss") + weight * F.col("div_loss"))
    aim = rows.agg(F.coalesce(F.avg(F.when(~tie, F.col("chosen_reward"))), F.avg(F.when(tie, F.greatest("chosen_reward", "rejected_reward")))).alias("aim"))
    short = lambda c: F.pow(F.greatest(F.col("aim") - F.col(c), F.lit(0.0)), F.lit(2.0))
    low = F.coalesce(F.avg(F.when(tie, short("chosen_reward") + short("rejected_reward"))), F.lit(0.0)) * 0.5
    summed = rows.crossJoin(F.broadcast(aim)).agg(pref.alias("pref_loss"), (match + floor_weight * low).alias("div_loss"))
    return summed.withColumn("loss", F.col("pref_loss") + weight * F.col("div_loss"))


def window_means(metrics: DataFrame, values: list[str], every: int, step: str = "step") -> DataFrame:
    """Of each window of `every` steps its last step and the means of what was stored in it; windows without any have no row."""
    at = F.floor(F.col(step) / every).cast("bigint")
    return metrics.groupBy(at.alias("window")).agg(F.max(step).alias(step), *(F.avg(v).alias(v) for v in values))
