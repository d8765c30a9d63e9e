"""Scalar readings that never fail: text and numbers as loosely typed records hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(c: Column) -> Column:
    """Text without white space of any script at its ends; null becomes ''."""
    return F.coalesce(F.regexp_replace(c.cast("string"), f"^{_SPACE}+|{_SPACE}+$", ""), F.lit(""))


def int_or(c: Column, default: int | None = 0) -> Column:
    """A whole number, or the default: '7.0' and '' give the default, ' 7 ' gives 7, true gives 1; of a number its whole part, 7.9 gives 7."""
    kind = F.typeof(c)
    whole = F.when(kind.isin("double", "float") | kind.startswith("decimal"), c.try_cast("double").try_cast("bigint"))
    flag = c.cast("string").isin("true", "false")
    text = F.when(flag, (c.cast("string") == "true").cast("int").cast("string")).otherwise(strip(c))
    return F.coalesce(whole, text.try_cast("bigint"), F.lit(default).cast("bigint"))


def float_or(c: Column, default: float | None = 0.0) -> Column:
    """A number, or the default: '1e3' and 'nan' are numbers."""
    return F.coalesce(strip(c).try_cast("double"), F.lit(default).cast("double"))


def bool_or_null(c: Column) -> Column:
    """1, true, yes or 0, false, no in any case; else null."""
    text = F.lower(strip(c))
    return F.when(text.isin("1", "true", "yes", "1.0"), True).when(text.isin("0", "false", "no", "0.0"), False)


def at_least(c: Column, bound: float) -> Column:
    """c >= bound, false for null and NaN."""
    return F.coalesce((c >= bound) & ~F.isnan(c), F.lit(False))


def best_of(*columns: Column) -> Column:
    """The largest, nulls as 0."""
    return F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in columns))
