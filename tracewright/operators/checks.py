"""Constraints on rows and datasets: violations as DataFrames, or an error that names the first."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Values seen more than once, with their counts."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def missing(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Wanted keys without rows."""
    return wanted.select(key).distinct().join(rows.select(key), key, "left_anti")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each broken rule of each row: rule, and the row's columns."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select("*", F.explode(broken).alias("rule"))


def require(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows, or an error at the first row that breaks a rule."""
    for name, ok in rules.items():
        rows = rows.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast("boolean")))
    return rows


def pair_rules() -> dict[str, Column]:
    """What holds for every pair record."""
    return {
        "chosen is not empty": F.length(F.trim("chosen")) > 0,
        "rejected is not empty": F.length(F.trim("rejected")) > 0,
        "target is a probability": F.col("target_prob").between(0.0, 1.0),
        "weight is positive": F.col("weight") > 0,
        "a win over a loss has target 1": (F.col("pair_type") != "win_lose") | (F.abs(F.col("target_prob") - 1) <= 1e-6),
    }


def one_value(rows: DataFrame, column: str, expected: float, rel: float = 1e-9, abs_: float = 1e-12) -> bool:
    """Whether all rows have the expected value, within bounds."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    near = lambda x: x is not None and abs(x - expected) <= max(rel * max(abs(x), abs(expected)), abs_)
    return near(low) and near(high)


def schema_difference(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """Columns of a alone and of b alone."""
    return sorted(set(a.columns) - set(b.columns)), sorted(set(b.columns) - set(a.columns))


def _walk(a: DataType, b: DataType, path: str) -> Iterator[tuple[str, str, str, str]]:
    """(path, what, left, right) of each difference between two types."""
    here = path or "the row"
    if type(a) is not type(b):
        yield here, "type", a.simpleString(), b.simpleString()
    elif isinstance(a, StructType):
        left, right = {f.name: f for f in a.fields}, {f.name: f for f in b.fields}
        for name in [*left, *(n for n in right if n not in left)]:
            at = f"{path}.{name}" if path else name
            if name not in right:
                yield at, "missing", left[name].dataType.simpleString(), ""
            elif name not in left:
                yield at, "added", "", right[name].dataType.simpleString()
            else:
                if left[name].nullable != right[name].nullable:
                    yield at, "nullable", str(left[name].nullable).lower(), str(right[name].nullable).lower()
                yield from _walk(left[name].dataType, right[name].dataType, at)
    elif isinstance(a, ArrayType):
        if a.containsNull != b.containsNull:
            yield f"{path}[]", "nullable", str(a.containsNull).lower(), str(b.containsNull).lower()
        yield from _walk(a.elementType, b.elementType, f"{path}[]")
    elif isinstance(a, MapType):
        if a.valueContainsNull != b.valueContainsNull:
            yield f"{path}{{}}", "nullable", str(a.valueContainsNull).lower(), str(b.valueContainsNull).lower()
        yield from _walk(a.keyType, b.keyType, f"{path}{{key}}")
        yield from _walk(a.valueType, b.valueType, f"{path}{{}}")
    elif a != b:
        yield here, "type", a.simpleString(), b.simpleString()


def compatibility(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, what (missing, added, type, nullable), left and right: how b's schema differs from a's, at any depth.

    a.b is a field, a[] the items of a list, a{} the values of a map and a{key} its keys. Alike schemas give no rows.
    """
    found = list(_walk(a.schema, b.schema, ""))
    return a.sparkSession.createDataFrame(found, "path string, what string, left string, right string")


def is_compatible(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ("added", "nullable")) -> bool:
    """Whether rows of b can be read as rows of a: nothing missing, and no other types."""
    return all(what in ignore for _, what, _, _ in _walk(a.schema, b.schema, ""))
