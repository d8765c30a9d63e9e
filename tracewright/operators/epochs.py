"""Orders of an epoch as a keyed permutation, computed index by index: no sort, no list of all rows."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .zip import SMALL

#: A prime above any half of an index, and the number of rounds.
PRIME, ROUNDS = 2_147_483_647, 6
#: Widths that are tried for the one that leaves fewest places over.
TRIED = 4_096


@lru_cache(maxsize=256)
def shape(n: int) -> tuple[int, int]:
    """Two widths whose product is n or a little more."""
    low = max(1, isqrt(n - 1) + 1) if n > 1 else 1
    return min(((a, -(-n // a)) for a in range(low, low + TRIED)), key=lambda s: (s[0] * s[1] - n, s[0]))


def keys(seed: int | str, epoch: int, list_of: str = "") -> list[tuple[int, int, int]]:
    """Three numbers for each round."""
    found = []
    for k in range(ROUNDS):
        digest = hashlib.sha256(f"{seed}:{epoch}:{list_of}:{k}".encode()).digest()
        found.append(tuple(int.from_bytes(digest[i : i + 8], "big") % (PRIME - 1) + 1 for i in (0, 8, 16)))
    return found


def permuted(index: Column, n: int, of: list[tuple[int, int, int]]) -> Column:
    """The place of each index from 0 to n - 1 in a permutation of them.

    A Feistel network over pairs (left below a, right below b), where a * b is n or a little more; an index that lands on one of
    the places over is sent through again, as often as there are such places at most, so that every index arrives.
    """
    if n <= 1:
        return index.cast("bigint")
    a, b = shape(n)

    # each round names its halves once, so that the expression grows with the rounds and not with their powers
    def network(x: Column) -> Column:
        state = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).cast("bigint").alias("r"))
        rounds = F.array(*(F.struct(F.lit(k % 2).alias("side"), *(F.lit(v).cast("bigint").alias(f"k{i}") for i, v in enumerate(key))) for k, key in enumerate(of)))

        def step(s: Column, r: Column) -> Column:
            other = F.when(r["side"] == 1, s["l"]).otherwise(s["r"])
            left, right = (other % PRIME + r["k0"]) % PRIME, (other % PRIME + r["k1"]) % PRIME
            f = ((left * right) % PRIME * r["k2"] + left) % PRIME
            return F.struct(F.when(r["side"] == 1, s["l"]).otherwise((s["l"] + f) % a).alias("l"), F.when(r["side"] == 1, (s["r"] + f) % b).otherwise(s["r"]).alias("r"))

        return F.aggregate(rounds, state, step, lambda s: s["l"] * b + s["r"])

    over = a * b - n
    if not over:
        return network(index.cast("bigint"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(over + 1)), F.lit(-1).cast("bigint"), lambda x, i: F.when((x >= 0) & (x < n), x).otherwise(network(F.when(x < 0, index.cast("bigint")).otherwise(x))))


def epoch_order(rows: DataFrame, n: int, seed: int | str, epoch: int, index: str = "i", list_of: str = "") -> DataFrame:
    """rows with place, their position in this epoch's order; index counts them from 0 without gaps."""
    return rows.withColumn("place", permuted(F.col(index), n, keys(seed, epoch, list_of)))


def balanced_epoch(a: DataFrame, b: DataFrame, sizes: tuple[int, int], seed: int, epoch: int, index: str = "i") -> DataFrame:
    """place, a's and b's columns (a_ and b_ before their names): one epoch over two lists, as long as the longer one.

    Each list has an order of its own, keyed by seed + epoch + 1; the shorter one starts over. Both have an index from 0 without
    gaps, and sizes are their numbers of rows. Lists meet the places by equi-joins on the index; nothing is sorted. A list
    without rows is an error.
    """
    n, m = sizes
    if not n or not m:
        raise ValueError("both lists need rows")
    places = a.sparkSession.range(max(n, m)).select(
        F.col("id").alias("place"), permuted(F.col("id") % n, n, keys(seed + epoch + 1, 0, "a")).alias(f"a_{index}"), permuted(F.col("id") % m, m, keys(seed + epoch + 1, 0, "b")).alias(f"b_{index}")
    )
    small = lambda side, size: F.broadcast(side) if size <= SMALL else side  # noqa: E731  a row of a longer one stands at few places
    left = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    return places.join(small(left, n), f"a_{index}").join(small(right, m), f"b_{index}")
