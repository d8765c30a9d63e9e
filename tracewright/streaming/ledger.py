"""A collection's ledger as a stream: records arrive in files, the last complete one of a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.resume import KEY, merged

BATCH = "batch"


def records(spark: SparkSession, folder: str, schema: str, files_at_once: int = 64) -> DataFrame:
    """Records as files of JSON lines arrive in the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def once(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Each key once; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def keep_ledger(stream: DataFrame, ledger: str, checkpoint: str, key: list[str] | None = None, order: str = "ord") -> StreamingQuery:
    """Add each batch to the ledger folder: one record for each key that the batch has, in a folder named by the batch.

    What a batch writes grows with the batch alone. A batch that runs again overwrites its own folder, so each record counts
    once. holding() reads the ledger, compact() makes one folder of it.
    """
    keys = key or KEY

    def add(batch: DataFrame, number: int) -> None:
        merged(batch.limit(0), batch, keys, order).write.mode("overwrite").parquet(f"{ledger}/{BATCH}={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def holding(spark: SparkSession, ledger: str, key: list[str] | None = None, order: str = "ord") -> DataFrame:
    """One record a key: that of the last batch that has it."""
    keys = key or KEY
    rows = spark.read.parquet(ledger)
    rest = [c for c in rows.columns if c not in [*keys, BATCH]]
    return rows.groupBy(keys).agg(F.max_by(F.struct(*rest), F.struct(BATCH, order)).alias("_r")).select(*keys, "_r.*")


def compact(spark: SparkSession, ledger: str, into: str, key: list[str] | None = None, order: str = "ord") -> None:
    """Write what the ledger holds to another folder, as batch -1: a ledger that later batches may be added to."""
    holding(spark, ledger, key, order).write.mode("overwrite").parquet(f"{into}/{BATCH}=-1")
