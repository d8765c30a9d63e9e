"""Typed artifacts from JSON: trajectories, branch sets and pair datasets, with a quarantine for rows that are none.

A kind is a list of fields: (name, how it is read, needed). A row without a needed field, or with one that can't be read so, is
bad; its reason names the field by its path. Good and bad rows together are all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType

from ..functions import variants as V
from ..functions.casts import strip
from .strict_lines import fault_of

#: The fields of each kind.
STEP = [("step_index", "whole", True), ("observation", "text", True), ("action", "text", True), ("raw_model_output", "raw", False), ("reward", "number?", False), ("done", "truth", False), ("metadata", "object", False)]
BRANCH = [("branch_id", "text", True), ("trajectory_id", "text", True), ("divergence_step", "whole", True), ("action", "text", True), ("won", "truth", True), ("score", "number?", False), ("response_text", "text", True), ("metadata", "object", False)]
PAIR = [("prompt_text", "text", True), ("chosen_text", "text", True), ("rejected_text", "text", True), ("pair_type", "text", True), ("target_prob", "number", True), ("weight", "number=1", False), ("metadata", "object", False)]
KINDS: dict[str, list[tuple]] = {
    "trajectory": [("benchmark", "text", True), ("task_id", "text", True), ("trajectory_id", "text", True), ("model_id", "text", True), ("seed", "whole", True), ("won", "truth", True), ("score", "number?", False), ("steps", STEP, False), ("metadata", "object", False)],
    "branch_set": [("benchmark", "text", True), ("task_id", "text", True), ("collection_method", "text", True), ("source_trajectory_id", "text", True), ("divergence_step", "whole", True), ("prompt_text", "text", True), ("branches", BRANCH, False), ("metadata", "object", False)],
    "pair_dataset": [("benchmark", "text", True), ("task_id", "text", True), ("collection_method", "text", True), ("dataset_method", "text", True), ("training_method", "text", True), ("records", PAIR, False), ("metadata", "object", False)],
}


def _nothing() -> Column:
    return F.parse_json(F.lit("{}"))


def _read(v: Column, how: str) -> tuple[Column, str | None]:
    """What a field is read as, and what to say where it can't be read so; v is null where the field is missing."""
    if how == "text":
        return V.text(v), None
    if how == "whole":
        return V.whole(v), "is no whole number"
    if how == "truth":
        return F.coalesce(V.truth(v), F.lit(False)), None
    if how == "raw":
        return V.let(v, lambda x: F.when(~F.is_variant_null(x), V.text(x))), None
    if how == "object":
        return F.when(v.isNull(), _nothing()).otherwise(F.when(V.is_object(v), v)), "is no object"
    if how.startswith("number"):
        return F.when(v.isNull(), 1.0).otherwise(V.number(v)) if how == "number=1" else V.number(v), "is no number"
    raise ValueError(f"no reading {how}")


def _fields(v: Column, spec: list[tuple]) -> tuple[Column, Column]:
    """The struct of an object's fields, and the first thing that is wrong, by its path."""
    made, wrong = [], []
    for name, how, needed in spec:
        own = V.field(v, name)
        if needed:
            wrong.append(F.when(own.isNull(), f"{name} is missing"))
        if isinstance(how, list):
            every = V.items(own)
            wrong.append(F.when(own.isNotNull() & every.isNull(), f"{name} is no list"))
            got = _items(every, how, name)
            wrong.append(F.try_element_at(F.filter(F.transform(got, lambda x: x["bad"]), lambda x: x.isNotNull()), F.lit(1)))
            made.append(F.transform(got, lambda x: x["row"]).alias(name))
            continue
        value, bad = _read(own, how)
        if bad:
            absent = own.isNull() | F.is_variant_null(own) if how == "number?" else own.isNull()
            wrong.append(F.when(value.isNull() & ~absent, f"{name} {bad}"))
        made.append(value.alias(name))
    return F.struct(*made), F.coalesce(*wrong)


def _items(every: Column, spec: list[tuple], name: str) -> Column:
    """row and bad of each item of a list."""

    def one(x: Column, i: Column) -> Column:
        row, bad = _fields(x, spec)
        bad = F.when(~V.is_object(x), "is no object").otherwise(bad)
        return F.struct(row.alias("row"), F.when(bad.isNotNull(), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("] "), bad)).alias("bad"))

    return F.transform(F.coalesce(every, F.array().cast("array<variant>")), one)


@F.pandas_udf(StringType())
def json_fault(text: pd.Series) -> pd.Series:
    """Why a text is no JSON object; null if it is one."""
    return text.map(lambda t: "no text" if t is None else fault_of(t.strip()))


def judged(rows: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """rows with artifact (the typed row) and reason (null, or why it is none).

    An object that names a key twice, or NaN, is bad here: Variant holds neither.
    """
    v = F.try_parse_json(strip(F.col(text)))
    fault = json_fault(F.col(text))
    held = rows.withColumns({"_v": v, "_fault": fault})
    row, bad = _fields(F.col("_v"), KINDS[kind])
    reason = F.coalesce(F.col("_fault"), F.when(F.col("_v").isNull(), "invalid JSON: a key twice or no number"), bad)
    return held.withColumns({"reason": reason, "artifact": row}).drop("_v", "_fault")


def typed(rows: DataFrame, kind: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The artifacts of a kind, and the quarantine: text and reason of all other rows. Blank rows count in neither."""
    every = judged(rows.where(strip(F.col(text)) != ""), kind, text)
    return every.where("reason is null").select("artifact.*"), every.where("reason is not null").select(F.col(text).alias("text"), "reason")


def read(spark: SparkSession, paths: str | list[str], kind: str, quarantine: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Artifacts from files: a line each, but for pair datasets, which are a file each.

    A bad row is an error that says why; with `quarantine`, it is a row of the second table given back.
    """
    source = spark.read.text(paths, wholetext=kind == "pair_dataset").withColumnRenamed("value", "text")
    if quarantine:
        return typed(source, kind)
    rows = judged(source.where(strip(F.col("text")) != ""), kind)
    sound = F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"no {kind}: "), F.col("reason"))).cast("boolean"))
    return rows.where(sound).select("artifact.*")


def first_table(spark: SparkSession, folder: str, names: tuple[str, ...] = ("trajectories.jsonl", "base_trajectories.jsonl")) -> DataFrame:
    """Trajectories of the first of these files that a folder has; none of them, or one without rows, is an error."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = read(spark, path.toString(), "trajectory")
            if rows.isEmpty():
                raise ValueError(f"no trajectories in {path.toString()}")
            return rows
    raise ValueError(f"{folder} has none of {', '.join(names)}")


def in_order(column: Column, kind: DataType) -> Column:
    """A value with the fields of every struct, and the keys of every map, in order of their names."""
    if isinstance(kind, StructType):
        parts = [in_order(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(kind, ArrayType) and _has_names(kind.elementType):
        return F.transform(column, lambda x: in_order(x, kind.elementType))
    if isinstance(kind, MapType):
        values = F.transform_values(column, lambda _, x: in_order(x, kind.valueType)) if _has_names(kind.valueType) else column
        return F.map_from_entries(F.array_sort(F.map_entries(values))) if isinstance(kind.keyType, StringType) and not _has_variant(kind.valueType) else values
    return column  # a Variant holds its keys in order


def _has_names(kind: DataType) -> bool:
    return isinstance(kind, (StructType, MapType)) or (isinstance(kind, ArrayType) and _has_names(kind.elementType))


def _has_variant(kind: DataType) -> bool:
    inner: Callable[[DataType], list[DataType]] = lambda k: [f.dataType for f in k.fields] if isinstance(k, StructType) else [k.elementType] if isinstance(k, ArrayType) else [k.valueType] if isinstance(k, MapType) else []
    return isinstance(kind, VariantType) or any(_has_variant(k) for k in inner(kind))


def json_text(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as a JSON object with sorted keys, nulls written."""
    names = sorted(columns or rows.columns)
    return F.to_json(F.struct(*(in_order(F.col(f"`{c}`"), rows.schema[c].dataType).alias(c) for c in names)), {"ignoreNullFields": "false"})
