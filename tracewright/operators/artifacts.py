"""Typed artifacts: branch sets, pair records, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def branch_sets(branches: DataFrame, key: list[str], item: list[str], order: str) -> DataFrame:
    """One row a key with its branches in order; a set holds the alternatives of one state."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order), *(c for c in item if c != order))))
    return branches.groupBy(key).agg(packed.alias("branches"), F.count(F.lit(1)).alias("branch_count"))


def target_probability(pair_type: Column, explicit: Column) -> Column:
    """The explicit target unless it is missing or 0; else a half for two wins, one otherwise."""
    return F.coalesce(F.nullif(explicit, F.lit(0.0)), F.when(pair_type == "win_win", 0.5).otherwise(1.0))


def pair_weight(weight: Column) -> Column:
    return F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(1.0))


def branch_score(progression: Column, reward: Column) -> Column:
    """Progression unless missing or 0, then the reward."""
    return F.coalesce(F.nullif(progression, F.lit(0.0)), reward)


def pair_records(rows: DataFrame, weight: Column, target: Column) -> DataFrame:
    """Flat pairs as typed records with lineage in metadata."""
    meta = F.to_json(F.struct("pair_semantics", "pair_origin", "chosen_trajectory_id", "rejected_trajectory_id"))
    return rows.select("task_slug", "pair_type", F.col("chosen_action_text").alias("chosen"), F.col("rejected_action_text").alias("rejected"), target_probability(F.col("pair_type"), target).alias("target_prob"), pair_weight(weight).alias("weight"), meta.alias("metadata"))


def first_metric(*candidates: Column) -> Column:
    """The first number; above 1 it is a percentage."""
    x = F.coalesce(*candidates)
    return F.when(x > 1, x / 100).otherwise(x)


def with_missing(metrics: DataFrame, suites: DataFrame) -> DataFrame:
    """A row for each suite that was asked for; status says whether a metric is there."""
    return suites.join(metrics, "suite", "left").withColumn("status", F.when(F.col("mean").isNull(), "missing").otherwise("ok"))
