"""Scores kept from run to run: a table addressed by what was scored and by whom, so that nothing is scored twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import exists
from .stages import Scorer

#: Folders that the table falls into, by the first letter of the address.
SHELF = 1


def address(key: list[str], scorer: str) -> Column:
    """The digest of a key's values and the scorer's name and version."""
    return F.sha2(F.to_json(F.struct(F.lit(scorer).alias("scorer"), *(F.col(c) for c in key)), {"ignoreNullFields": "false"}), 256)


def known(spark: SparkSession, folder: str) -> DataFrame:
    """address and score of all that was scored; of an address that two runs added at once, one row."""
    schema = "address string, score double, shelf string"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).groupBy("address").agg(F.max("score").alias("score"))


def scored_once(rows: DataFrame, scorer: Scorer, key: list[str], folder: str, name: str, score: str = "score") -> DataFrame:
    """rows with the scorer's column. Distinct keys that the table in `folder` doesn't hold are scored and added to it; the
    rest is looked up. The scorer sees and gives the key's columns; nulls in a key are values."""
    spark = rows.sparkSession
    keyed = rows.withColumn("_address", address(key, name))
    wanted = keyed.groupBy("_address").agg(*(F.first(c).alias(c) for c in key))
    fresh = wanted.join(known(spark, folder), F.col("_address") == F.col("address"), "left_anti")
    got = scorer(fresh.select(*key)).select(address(key, name).alias("address"), F.col(score).cast("double").alias("score"))
    got.dropDuplicates(["address"]).withColumn("shelf", F.substring("address", 1, SHELF)).write.mode("append").partitionBy("shelf").parquet(folder)
    held = known(spark, folder).select(F.col("address").alias("_address"), F.col("score").alias(score))
    return keyed.join(held, "_address", "left").drop("_address")
