"""Tables written so that a reader sees all of one or nothing: rows in a staging folder, a manifest last, then the name.

Spark's writers already keep the rows of failed tasks apart; here the whole table stays out of sight until its files have been read
back, counted and summed up in manifest.json. Whoever reads through committed_rows() gets a table whose manifest is there
and says what its files hold.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import json_text
from .traces import manifest_text

MANIFEST = "manifest.json"


def _path(spark: SparkSession, name: str) -> tuple[Any, Any]:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, store = _path(spark, name)
    return store.exists(path)


def write_json(spark: SparkSession, name: str, payload: dict) -> None:
    """One small JSON file with sorted keys, two spaces in and a line end, in any store that Spark writes to. It appears whole or not at all."""
    path, store = _path(spark, name)
    aside, _ = _path(spark, f"{path.getParent().toString()}/.{path.getName()}-{uuid.uuid4().hex}")
    out = store.create(aside, True)
    try:
        out.write(manifest_text(payload).encode())
    finally:
        out.close()
    store.delete(path, False)
    if not store.rename(aside, path):
        store.delete(aside, False)
        raise OSError(f"{name} could not be written")


def read_json(spark: SparkSession, name: str) -> dict:
    rows = spark.read.text(name, wholetext=True).collect()  # one file of one object
    if len(rows) != 1 or not isinstance(found := json.loads(rows[0][0]), dict):
        raise ValueError(f"{name} is no JSON object")
    return found


def _summed(lines: DataFrame) -> list[Column]:
    """Rows, and a sum over them that doesn't hang on their order."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("sum")]


def _files(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Rows and sum of each file of lines below a folder, by its name from there on."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    found = {}
    for r in lines.groupBy("file").agg(*_summed(lines)).collect():  # a row a file
        name = r["file"].rsplit("/rows/", 1)[-1]
        found[name] = {"rows": r["rows"], "sum": r["sum"]}
    return found


def commit(rows: DataFrame, folder: str, about: dict | None = None, by: list[str] | None = None, overwrite: bool = False) -> dict:
    """Write rows as JSON lines (sorted keys, nulls written; by: a folder for each value) and give back the manifest.

    The folder gets its name when all is written and counted. If anything fails before that, what was written goes and a table that had the
    name stays. A folder that is there is an error unless it may be overwritten.
    """
    spark = rows.sparkSession
    target, store = _path(spark, folder.rstrip("/"))
    if store.exists(target) and not overwrite:
        raise FileExistsError(f"{folder} is there already")
    staging, _ = _path(spark, f"{target.getParent().toString()}/_{target.getName()}-{uuid.uuid4().hex}")
    began = time.time()
    try:
        text = json_text(rows, [c for c in rows.columns if c not in (by or [])])
        out = rows.select(*(by or []), text.alias("value")).write
        (out.partitionBy(*by) if by else out).text(f"{staging.toString()}/rows")
        files = _files(spark, f"{staging.toString()}/rows")
        manifest = dict(about or {}) | {"columns": sorted(rows.columns), "files": files, "rows": sum(f["rows"] for f in files.values()), "seconds": round(time.time() - began, 3), "status": "ok"}
        write_json(spark, f"{staging.toString()}/{MANIFEST}", manifest)
        old = None
        if store.exists(target):
            old, _ = _path(spark, f"{staging.toString()}-old")
            store.rename(target, old)
        if not store.rename(staging, target):
            if old is not None:
                store.rename(old, target)
            raise OSError(f"{folder} could not be named")
        if old is not None:
            store.delete(old, True)
    except BaseException:
        for _ in range(50):  # tasks of a job that failed may be writing for a moment longer
            store.delete(staging, True)
            time.sleep(0.1)
            if not store.exists(staging):
                break
        raise
    return manifest


def committed_rows(spark: SparkSession, folder: str, schema: str, check: bool = False) -> DataFrame:
    """The rows of a committed table; an error without its manifest. check: also one where its files don't hold what that says."""
    if not exists(spark, f"{folder.rstrip('/')}/{MANIFEST}"):
        raise ValueError(f"{folder} was not committed: it has no {MANIFEST}")
    if check and (said := read_json(spark, f"{folder.rstrip('/')}/{MANIFEST}")["files"]) != (found := _files(spark, f"{folder.rstrip('/')}/rows")):
        differ = sorted(k for k in said.keys() | found.keys() if said.get(k) != found.get(k))
        raise ValueError(f"{folder} is not as its manifest says: {', '.join(differ[:5])}")
    return spark.read.schema(schema).json(f"{folder.rstrip('/')}/rows")


def run_stage(stage: str, make: Callable[[], DataFrame], folder: str, config: dict, counts: dict[str, Column] | None = None, overwrite: bool = False) -> dict:
    """Run a stage: its rows committed, its manifest with configuration, counts (sums of flags) and run time, and what is given
    back. counts are taken in the pass that reads the rows back."""
    rows = make()
    manifest = commit(rows, folder, {"stage": stage, "config": config}, overwrite=overwrite)
    if counts:
        back = committed_rows(rows.sparkSession, folder, rows.schema)
        totals = back.agg(*(F.count_if(c).alias(n) for n, c in counts.items())).first().asDict()
        manifest |= {"counts": totals}
        write_json(rows.sparkSession, f"{folder.rstrip('/')}/{MANIFEST}", manifest)
    return manifest
