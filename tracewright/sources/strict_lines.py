"""JSON lines read strictly: a line that is no object is named by its file and line number, however the file is split.

Files are read by Spark's text source, which cuts them into ranges of bytes. A task walks its ranges in order and knows a line's
place within its range; how many lines the ranges before it hold comes from one count a range. So no file is read in one task,
and what is summed over a file is one number a range.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.casts import strip

_SCAN = {"file": pa.string(), "begin": pa.int64(), "lines": pa.int64(), "rows": pa.int64(), "at": pa.int64(), "reason": pa.string(), "text": pa.string()}


def fault_of(text: str) -> str | None:
    """Why a line that isn't blank is no row."""
    try:
        found = json.loads(text)
    except ValueError as e:
        return f"invalid JSON: {e}"
    except RecursionError:
        return "invalid JSON: nested too deeply"
    return None if isinstance(found, dict) else "row must be an object"


def _scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Of each range of bytes one row with its lines and rows (lines that aren't blank), and one row for each fault in it."""
    read = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, rows = None, 0, 0
        for batch in batches:
            out = []
            for file, begin, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, begin) != now:
                    if now:
                        out.append((*now, lines, rows, None, None, None))
                    now, lines, rows = (file, begin), 0, 0
                lines += 1
                if text := text.strip():
                    rows += 1
                    if reason := fault_of(text):
                        out.append((file, begin, 0, 0, lines, reason, text))
            yield _batch(out)
        if now:
            yield _batch([(*now, lines, rows, None, None, None)])

    return read.mapInArrow(run, "file string, begin bigint, lines bigint, rows bigint, at bigint, reason string, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_SCAN)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCAN.values(), strict=True)], names=list(_SCAN))


def faults(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line (from 1), reason and text of each line that is neither blank nor an object."""
    found = _scan(spark, [paths] if isinstance(paths, str) else paths)
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    ranges = found.where("reason is null").select("file", "begin", F.coalesce(before, F.lit(0)).alias("before"))  # a row a range of bytes
    return found.where("reason is not null").join(ranges, ["file", "begin"]).select("file", (F.col("before") + F.col("at")).alias("line"), "reason", "text")


def numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line (from 1) and text, without white space at its ends, of each line that isn't blank, be it a row or none.

    One look counts the lines of each range of bytes, another numbers them.
    """
    paths = [paths] if isinstance(paths, str) else paths
    read = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            found = []
            for file, begin, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now, at = (file, begin), at + 1 if (file, begin) == now else 1
                if text := text.strip():
                    found.append((file, begin, at, text))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "begin", "at", "text"])

    lines = read.mapInArrow(run, "file string, begin bigint, at bigint, text string")
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    ranges = _scan(spark, paths).where("reason is null").select("file", "begin", F.coalesce(before, F.lit(0)).alias("before"))  # a row a range of bytes
    return lines.join(ranges, ["file", "begin"]).select("file", (F.col("before") + F.col("at")).alias("line"), "text")


def files_without_rows(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files below the paths that have no rows, empty ones among them, in order. The driver holds file names, as Spark's listing does."""
    paths = [paths] if isinstance(paths, str) else paths
    some = {_plain(r["file"]) for r in _scan(spark, paths).where("rows > 0").select("file").distinct().collect()}
    return sorted(f for f in spark.read.text(paths).inputFiles() if _plain(f) not in some)


def _plain(file: str) -> str:
    """file:/x and file:///x are the same."""
    return re.sub(r"^([a-z][a-z0-9+.-]*):/+", r"\1:/", file)


def strict_json_lines(spark: SparkSession, paths: str | list[str], schema: str | StructType, non_empty: bool = False) -> DataFrame:
    """Rows of JSON-lines files; blank lines don't count.

    A ValueError names the first line, by file and number, that is no object (non_empty: also the first file without rows).
    Within a sound line, a field that doesn't fit the schema is null, and fields that the schema doesn't name are left out.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if not _scan(spark, paths).where("reason is not null").isEmpty():  # one look at all; only a fault costs another
        bad = faults(spark, paths).orderBy("file", "line").first()
        raise ValueError(f"{bad['file']}:{bad['line']} {bad['reason']}")
    if non_empty and (empty := files_without_rows(spark, paths)):
        raise ValueError(f"{empty[0]} has no rows")
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.text(paths).select(strip(F.col("value")).alias("t")).where("t <> ''").select(F.from_json("t", kind).alias("r")).select("r.*")
