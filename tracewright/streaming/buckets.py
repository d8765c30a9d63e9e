"""A ledger in hash buckets: a batch rewrites the buckets of its own keys and no others.

A batch writes its buckets under its own number, then a list of which number holds which bucket. The list appears whole and
last, so a reader sees a batch in all its buckets or in none; a batch that runs again finds its list and changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.resume import KEY
from ..sources.commits import read_json, write_json
from ..sources.shared import kept

BUCKETS = 64


def _lists(spark: SparkSession, ledger: str) -> list[int]:
    """Numbers of the batches whose lists are there, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/lists")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [f.getPath().getName() for f in store.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def state(spark: SparkSession, ledger: str) -> dict | None:
    """What the last batch says: number, buckets, schema, and `held`, the number that holds each bucket."""
    numbers = _lists(spark, ledger)
    return read_json(spark, f"{ledger}/lists/{numbers[-1]:020d}.json") if numbers else None


def bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, ledger: str, said: dict, only: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(said["schema"]))
    paths = [f"{ledger}/rows/batch={n}/bucket={b}" for b, n in said["held"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, ledger: str, batch: DataFrame, number: int, key: list[str] | None = None, order: str = "ord", buckets: int = BUCKETS) -> list[int]:
    """Merge a batch into the ledger: of a key, the record with the largest order holds, the batch's one of equals. Gives the buckets written.

    Batches come in order of their numbers; one that has come already changes nothing. What is read and written are the buckets
    of the batch's keys.
    """
    keys = key or KEY
    said = state(spark, ledger)
    if said and number <= said["number"]:
        return []
    many = said["buckets"] if said else buckets
    own = kept(batch.withColumn("bucket", bucket(keys, many)))
    touched = sorted(r["bucket"] for r in own.select("bucket").distinct().collect())  # as many as buckets
    rows = own.drop("bucket")
    held = _read(spark, ledger, said, set(touched)).select(rows.columns) if said else rows.limit(0)
    rows = _latest(held, rows, keys, order).select(batch.columns).withColumn("bucket", bucket(keys, many))
    if touched:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{ledger}/rows/batch={number}")
    held = (said["held"] if said else {}) | {str(b): number for b in touched}
    write_json(spark, f"{ledger}/lists/{number:020d}.json", {"number": number, "buckets": many, "schema": batch.schema.json(), "held": held})
    return touched


def _latest(held: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    both = held.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    rest = [c for c in held.columns if c not in keys]
    return both.groupBy(keys).agg(F.max_by(F.struct(*rest), F.struct(order, "_new")).alias("_r")).select(*keys, "_r.*")


def held_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """One record a key."""
    said = state(spark, ledger)
    if not said:
        raise ValueError(f"{ledger} is no ledger")
    return _read(spark, ledger, said)


def records_of(spark: SparkSession, ledger: str, wanted: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The records of the wanted keys, from their buckets alone."""
    keys = key or KEY
    said = state(spark, ledger)
    if not said:
        raise ValueError(f"{ledger} is no ledger")
    asked = wanted.select(keys).distinct()
    only = {r["bucket"] for r in asked.select(bucket(keys, said["buckets"]).alias("bucket")).distinct().collect()}  # as many as buckets
    return _read(spark, ledger, said, only).join(asked, keys, "left_semi")


def sweep(spark: SparkSession, ledger: str) -> int:
    """Take away batches that hold no bucket any more, and all lists but the last; gives how many batches went. No reader may be on an older list."""
    said, numbers = state(spark, ledger), _lists(spark, ledger)
    if not said:
        return 0
    held, gone = set(said["held"].values()), 0
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/rows")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in store.listStatus(root):
        number = int(f.getPath().getName().removeprefix("batch="))
        if number not in held and number <= said["number"]:
            gone += bool(store.delete(f.getPath(), True))
    for n in numbers[:-1]:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/lists/{n:020d}.json"), False)
    return gone


def keep_buckets(stream: DataFrame, ledger: str, checkpoint: str, key: list[str] | None = None, order: str = "ord", buckets: int = BUCKETS) -> StreamingQuery:
    """Upsert each batch of a stream of records."""
    return stream.writeStream.foreachBatch(lambda batch, number: upsert(batch.sparkSession, ledger, batch, number, key, order, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
