"""The folder that driver and executors share, and tables that are kept there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session in one local process may do without: it gets a temporary folder that goes at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="tracewright-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """The name of a new folder in the shared one, which goes when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{own_folder(spark)}/{what}-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return path.toString()


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed once and written to the shared folder: a lost executor takes nothing of them along, and what reads them twice
    reads the same partitions in the same order. Spark's cleaner drops them with the last reference."""
    own_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)
