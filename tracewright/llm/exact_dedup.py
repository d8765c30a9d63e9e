"""Exact deduplication with a heavy-hitter split, in DataFrame operations alone.

A mergeable frequent-items summary of bounded size (Misra-Gries, as in Spark's approx_top_k) finds the digests that may
hold more than their share of all rows. Their exact winners and sizes, from a count with map-side combining, are at
most HEAVY rows: they are broadcast, and the rows of these digests never shuffle. The other digests go through
an ordinary shuffle, where no group is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small

#: Digests that the summary returns, and counters that it keeps: any digest with over 1/HEAVY of all rows is among them.
HEAVY, COUNTERS = 512, 8192
#: Rows (a key and a digest) of copies of the other digests up to which they are broadcast.
FEW_GONE = 200_000


def frequent(digests: DataFrame, column: str = "digest") -> DataFrame:
    """The values of column that may be frequent, HEAVY at most, from one pass with bounded state."""
    top = digests.agg(F.expr(f"approx_top_k({column}, {HEAVY}, {COUNTERS})").alias("top"))
    return top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias(column))


def _digested(docs: DataFrame, text: str, key: str, normal: Column | None = None) -> DataFrame:
    """doc_id and digest of each row, computed once and kept: 40 bytes a row stand for the texts in all that follows."""
    value = F.coalesce(normal if normal is not None else F.col(f"`{text}`"), F.lit(""))
    return cut(docs.select(F.col(f"`{key}`").alias("doc_id"), F.sha2(value, 256).alias("digest")))


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The exact winners of the frequent digests, HEAVY at most, and the rows of all other digests."""
    suspects = F.broadcast(frequent(rows))  # HEAVY rows at most
    heavy = F.broadcast(cut(_winners(rows.join(suspects, "digest", "left_semi")).where("group_size > 1")))  # as many as suspects
    return heavy, rows.join(heavy, "digest", "left_anti")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", normal: Column | None = None) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    normal: the text that is compared (default: the text itself, null as ''). Rows are equal when its SHA-256 is. The row
    with the largest key stays; keep_id is that key. Null keys are smaller than all others; if rows tie on the largest key,
    kept is true for each of them. An empty table gives an empty one; other columns are left out, whatever their names.
    """
    rows = _digested(docs, text, key, normal)
    heavy, light = _split(rows)
    found = rows.join(heavy, "digest").unionByName(light.join(_winners(light), "digest"))
    return found.select(
        F.col("doc_id").alias(key),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that exact_groups does not keep, all columns kept; of rows that tie on the kept key, one stays.

    Copies of frequent texts go on the map side, by the broadcast winners. Of the others, (key, digest) of the rows that go are
    counted: up to FEW_GONE they are broadcast and no text shuffles, beyond that the rows of docs, texts included, meet them in
    a shuffled join. Null texts equal empty ones; an empty table gives an empty one; columns may have any names.
    """
    rows = _digested(docs, text, key)
    heavy, light = _split(rows)
    of, keep, gone_id, gone_of, n = fresh(docs.columns, "digest", "keep", "gone_id", "gone_digest", "n")
    own = F.col(f"`{key}`")
    won = F.broadcast(heavy.select(F.col("digest").alias(gone_of), F.struct("keep_id").alias(keep)))
    signed = docs.withColumn(of, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    first = signed.join(won, F.col(of) == F.col(gone_of), "left").where(F.col(keep).isNull() | own.eqNullSafe(F.col(f"{keep}.keep_id"))).drop(gone_of, keep)
    gone = light.join(_winners(light).where("group_size > 1"), "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_of)).distinct()
    once = first.join(small(cut(gone), FEW_GONE), own.eqNullSafe(F.col(gone_id)) & (F.col(of) == F.col(gone_of)), "left_anti")
    tied = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_of))
    if tied.isEmpty():
        return once.select(*(F.col(f"`{c}`") for c in docs.columns))
    same = own.eqNullSafe(F.col(gone_id)) & (F.col(of) == F.col(gone_of))
    again = once.join(tied, same, "left_semi").dropDuplicates([key, of])
    return once.join(tied, same, "left_anti").unionByName(again).select(*(F.col(f"`{c}`") for c in docs.columns))
