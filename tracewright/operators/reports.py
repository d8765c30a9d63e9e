"""Reports of evaluation runs: everything that is said of a run comes from one pass over its episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shopping import signed

#: The metrics that a report over seeds gives.
METRICS = ("esd", "h_esd", "wsd", "h_wsd")


def _per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def run_report(episodes: DataFrame, by: list[str], key: str = "strategy", needs_signature: bool = False) -> DataFrame:
    """One row a run (the columns `by`): episodes, aborted ones, successes, ways to success and over all, their ratios, and what is missing.

    episodes: trajectory_id, is_success, aborted, signature ('' for none) and the way (null where it has none). An aborted episode is
    no success. Ways are counted first, by run and way, so that what shuffles is a row a way and task, and a run with most
    episodes is no large group. needs_signature: an error that counts successes without a signature and names the first five.
    """
    won = F.col("is_success") & ~F.col("aborted")
    unsigned = F.coalesce("signature", F.lit("")) == ""
    if needs_signature:
        signed(episodes.withColumn("is_success", won).withColumn("signature", F.coalesce("signature", F.lit(""))))
    ways = episodes.groupBy(*by, key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("aborted")).alias("a"), F.count_if(won).alias("c"), F.count_if(unsigned).alias("u"), F.count_if(unsigned & won).alias("uw"),
    )
    c, has = F.col("c"), F.col(key).isNotNull()
    found = ways.groupBy(*by).agg(
        F.sum("n").alias("trajectory_count"), F.sum("a").alias("non_aborted_count"), F.sum("c").alias("success_count"), F.count_if(c > 0).alias("unique_success_strategy_count"), F.max("c").alias("_top"),
        F.sum(F.when(c > 0, c * F.log(c))).alias("_spread"), F.count_if(has & (F.col("a") > 0)).alias("unique_total_strategy_count"), F.sum("u").alias("missing_signature_count"),
        F.sum("uw").alias("missing_success_signature_count"), F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("undefined_strategy_key_count"),
    )
    total, alive, wins, some, every = (F.col(x) for x in ("trajectory_count", "non_aborted_count", "success_count", "unique_success_strategy_count", "unique_total_strategy_count"))
    effective = F.when(wins > 0, F.exp(F.log(wins) - F.col("_spread") / wins)).otherwise(0.0)
    return found.select(
        *by, "trajectory_count", "non_aborted_count", (total - alive).alias("aborted_count"), "success_count", _per(wins, total).alias("success_at_k"), _per(wins, alive).alias("success_at_non_aborted"),
        "unique_success_strategy_count", effective.alias("entropy_effective_success_strategy_count"), _per(effective, total).alias("h_esd"), _per(some, total).alias("esd"), _per(some, alive).alias("esd_non_aborted"),
        _per(some, wins).alias("wsd"), _per(effective, wins).alias("h_wsd"), _per(F.col("_top"), wins).alias("top1_share"), "unique_total_strategy_count", _per(every, total).alias("total_div"),
        _per(every, alive).alias("total_div_non_aborted"), "missing_signature_count", "missing_success_signature_count", "undefined_strategy_key_count",
    )


def strategy_counts(episodes: DataFrame, by: list[str], key: str = "strategy") -> DataFrame:
    """by, the way and how often it leads to success: the report's histogram, a row a way."""
    return episodes.where(F.col("is_success") & ~F.col("aborted")).groupBy(*by, key).agg(F.count(F.lit(1)).alias("count"))


def over_seeds(runs: DataFrame, by: list[str], seed: str = "seed", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """by, metric, status, mean, std and per_seed: each metric of the runs, over seeds, in one pass.

    std is the population deviation, 0 for one run; per_seed is in order of seeds. A metric that no run has is missing, with no
    mean and an empty list.
    """
    named = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    long = runs.select(*by, seed, F.explode(named).alias("m")).select(*by, F.col(seed).alias("_seed"), "m.metric", "m.value")
    some = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("_seed", "value"))))  # a row a seed
    found = long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.transform(some, lambda x: x["value"]).alias("per_seed"))
    return found.withColumn("status", F.when(F.col("mean").isNull(), "missing").otherwise("ok")).select(*by, "metric", "status", "mean", "std", "per_seed")


def seed_report(episodes: DataFrame, by: list[str], seed: str = "seed", key: str = "strategy", needs_signature: bool = False) -> DataFrame:
    """run_report of every (by, seed), then over_seeds of it: three levels of groups, one pass over the episodes."""
    return over_seeds(run_report(episodes, [*by, seed], key, needs_signature), by, seed)
