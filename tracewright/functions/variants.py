"""Readings of loosely typed JSON, held as Variant: coercions, and the first of several paths that has a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import strip


def field(v: Column, name: str) -> Column:
    """The value under a key of an object, or under a path such as a.b; null where there is none (a JSON null is a value)."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it; the expression stays as small as it is written."""
    return F.element_at(F.transform(F.array(x), f), 1)


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def items(v: Column) -> Column:
    """The items of a list; null for anything else."""
    return let(v, lambda x: F.when(is_list(x), F.try_variant_get(x, "$", "array<variant>")))


def is_null(v: Column) -> Column:
    """Missing, or a JSON null."""
    return let(v, lambda x: x.isNull() | F.is_variant_null(x))


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def _said(v: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of a value's kind (null where there is none) and its text."""
    return let(v, lambda x: let(F.struct(kind(x).alias("k"), F.try_variant_get(x, "$", "string").alias("s")), lambda o: f(o["k"], o["s"])))


def plain(v: Column) -> Column:
    """A scalar's text as it is; null for objects, lists and nulls."""
    return _said(v, lambda k, s: F.when(~(k.startswith("OBJECT") | k.startswith("ARRAY") | (k == "VOID")), s))


def text(v: Column) -> Column:
    """A value as text: True and False for flags, None for a JSON null, the JSON of objects and lists; null where there is none."""
    return _said(v, lambda k, s: F.when(k == "VOID", "None").when(k == "BOOLEAN", F.initcap(s)).when(k.isNotNull(), s))


def _number(k: Column, s: Column) -> Column:
    nested = k.startswith("OBJECT") | k.startswith("ARRAY")
    return F.when(k == "BOOLEAN", F.when(s == "true", 1.0).otherwise(0.0)).when(~nested, strip(s).try_cast("double"))


def number(v: Column) -> Column:
    """A number, a number's text or a flag as a double; else null."""
    return _said(v, _number)


def whole(v: Column) -> Column:
    """A number without its fraction, a whole number's text or a flag as a long; else null."""

    def read(k: Column, s: Column) -> Column:
        of_text = let(strip(s), lambda t: F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")))  # not through a double, which has 53 bits
        of_number = let(_number(k, s), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x.try_cast("bigint")))
        return F.when(k.isin("STRING", "BIGINT"), of_text).otherwise(of_number)

    return _said(v, read)


def truth(v: Column) -> Column:
    """Whether a value counts as true: a JSON null, 0, '' and an empty object or list don't; null where there is none."""

    def read(k: Column, s: Column) -> Column:
        nothing = F.when(k.startswith("OBJECT"), s == "{}").when(k.startswith("ARRAY"), s == "[]").when(k == "STRING", s == "").when(k == "BOOLEAN", s == "false")
        return F.when(k == "VOID", False).when(k.isNotNull(), ~nothing.otherwise(F.coalesce(s.try_cast("double") == 0, F.lit(False))))

    return _said(v, read)


def first_number(v: Column, *names: str) -> Column:
    """The first of these fields that is a number or the text of one."""
    return let(v, lambda x: F.coalesce(*(number(field(x, n)) for n in names)))


def first_true(v: Column, *names: str) -> Column:
    """The first of these fields that counts as true, as a Variant; the last one where none does."""
    return let(v, lambda x: let(F.array(*(field(x, n) for n in names)), lambda every: F.coalesce(F.try_element_at(F.filter(every, truth), F.lit(1)), F.element_at(every, -1))))


def metric(v: Column, names: list[str]) -> Column:
    """A metric of a summary: the first of the names that is a number; else the first under `metrics`, there also as the mean
    or value of an object; else successes over episodes."""

    def nested(x: Column) -> Column:
        return F.when(is_object(x), number(first_true(x, "mean", "value"))).otherwise(number(x))

    def read(x: Column) -> Column:
        under = F.when(is_object(field(x, "metrics")), let(field(x, "metrics"), lambda m: F.coalesce(*(let(field(m, n), nested) for n in names))))
        counts = F.struct(number(first_true(x, "success_count", "num_success")).alias("won"), number(first_true(x, "episode_count", "num_episodes", "total")).alias("of"))
        return F.coalesce(*(number(field(x, n)) for n in names), under, let(counts, lambda c: F.when(c["of"] != 0, c["won"] / c["of"])))

    return let(v, read)


def share(x: Column) -> Column:
    """A metric above 1 is a percentage."""
    return let(x, lambda m: F.when(m > 1, m / 100).otherwise(m))


def success_share(v: Column) -> Column:
    """Successes over episodes, from whichever names of both are there; null without episodes."""
    counts = F.struct(first_number(v, "success_count", "num_success").alias("won"), first_number(v, "episode_count", "num_episodes", "total").alias("of"))
    return let(counts, lambda c: F.when(c["of"] != 0, c["won"] / c["of"]))
