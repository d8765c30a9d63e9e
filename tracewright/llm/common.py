"""What the corpus operators share: table access, shared storage, batching of texts and hashing of words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType, StructType

#: Bytes of text, and rows, that a Python worker handles at once.
SLICE_BYTES, SLICE_ROWS = 8 << 20, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all run in one local process,
    a folder of our own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{os.path.abspath(os.environ.get('TMPDIR', '/tmp'))}/tracewright-shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the taken ones."""
    taken, found = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def whole_number(df: DataFrame, key: str) -> Column:
    """The key column as a long; an error where it holds anything but whole numbers, which a cast would turn into nulls."""
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be of whole numbers, not {df.schema[key].dataType.simpleString()}")
    return F.col(f"`{key}`").cast("long")


def new_dir(spark: SparkSession, what: str) -> str:
    """The name of a new folder in the shared one, which goes when the driver's JVM ends."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tracewright/{what}-{uuid.uuid4().hex}")
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(base)
    store.deleteOnExit(base)
    return f"{base.toString()}/rows"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; Spark's cleaner drops it with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(rows: DataFrame, most: int) -> DataFrame:
    """rows, counted, and marked for broadcast while there are at most so many; rows should be kept (cut) already."""
    return F.broadcast(rows) if rows.count() <= most else rows


def fit_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of df's size, from the sizes of its files; 0 where it knows none."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 0


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each slice has at most `most` bytes of text and SLICE_ROWS rows, one row at least."""
    for batch in batches:
        start = size = 0
        column = batch.column(batch.schema.get_field_index(text))
        for i, n in enumerate(pc.binary_length(column).to_pylist()):
            if i > start and (size + (n or 0) > most or i - start == SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def gathered(parts: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive parts in lists of at least `most` bytes of text; the last may have fewer."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.column(part.schema.get_field_index(text)).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow, for columns of any names: that takes none with a dot."""
    names = df.columns
    if not any("." in c or "`" in c for c in names):
        return df.mapInArrow(run, schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(named, schema)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], keep: list[str], schema: str, text: str = "text") -> DataFrame:
    """df[keep] and, for each row, what a per-worker function makes of the texts (null: empty), a slice at a time."""
    types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calm()
        work = make()
        for part in slices(batches, text):
            made = work([x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()])
            columns = {k: part.column(part.schema.get_field_index(k)) for k in keep}
            yield pa.RecordBatch.from_pydict(columns | {k: v if isinstance(v, pa.Array) else pa.array(v, types[k]) for k, v in made.items()})

    kept = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    return map_arrow(df.select(*(F.col(f"`{c}`") for c in [*keep, text])), run, ", ".join([*kept, schema]))


_NONE = object()


class Recent(dict):
    """A bounded memo of two generations: when the young one is full, it becomes the old one, and what the old one held and
    nobody asked for meanwhile is forgotten. A key that it doesn't know gives None."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def room(self, n: int) -> None:
        """Make room for n more keys."""
        if len(self) + n > self.most:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key: Any) -> Any:
        if (known := self.old.get(key, _NONE)) is not _NONE:
            self[key] = known
            return known
        return None


class Memo(Recent):
    """A bounded memo of a function."""

    def __init__(self, make: Callable[[Any], Any], most: int):
        super().__init__(most)
        self.make = make

    def __missing__(self, key: Any) -> Any:
        if (known := self.old.get(key, _NONE)) is _NONE:
            known = self.make(key)
        if len(self) >= self.most:
            self.room(1)
        self[key] = known
        return known


#: White_Space of Unicode, which the tokenizers' \s takes. str.split() takes \x1c-\x1f besides.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_odd = re.compile("[\x1c-\x1f]")
_units = re.compile(f"[^{WHITE}]+")


def units(text: str) -> list[str]:
    """The pieces of text between white space."""
    return _units.findall(text) if _odd.search(text) else text.split()


def calm() -> None:
    """Make garbage collections rare in this worker: its memos hold many objects, and none of them in cycles."""
    gc.set_threshold(500_000, 20, 100)


_held: list[Callable] = []


def per_worker(make: Callable) -> Callable:
    """make, called once in a worker process and kept there until another operator asks for the room."""
    kept = lru_cache(maxsize=1)(make)
    _held.append(kept)
    return kept


def release() -> None:
    """Give back to the system what earlier tasks of this worker have freed, and what other operators keep in it."""
    for kept in _held:
        kept.cache_clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give back to the system what is free."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
