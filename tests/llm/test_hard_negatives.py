"""Hard negatives against brute force, over odd rows, ties, blocks and large numbers."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every=10, positives=5, negatives=3, low=50, high=95):
    sound = set()
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        sound.add((i, y, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    sound = sorted(sound)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    found = []
    for a in (r for r in sound if r[0] % every == 0):
        same = sorted((-dot(a[2], r[2]), r[0]) for r in sound if r != a and r[1] == a[1])[:positives]
        others = sorted((-dot(a[2], r[2]), r[0]) for r in sound if r[1] != a[1])
        for score, i in same:
            fits = [(s, k) for s, k in others if low * -score <= 100 * -s <= high * -score][:negatives]
            found += [(a[0], i, n + 1, k, -score, -s) for n, (s, k) in enumerate(fits)]
    return Counter(found)


def got(spark, rows, most=hn.ANCHORS, every=10, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("mine") for c in ("id", "vector", "cell", "slot", "score", "rank")})
    found = hn.hard_negatives(frame, F.col("id") % every == 0, most=most, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in found.collect())


def vectors(seed, n, dim=8, labels=4, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    x = centers[rng.integers(6, size=n)] + rng.normal(scale=spread, size=(n, dim))
    y = np.where(rng.random(n) < 0.4, 0, rng.integers(labels, size=n))
    return [(int(i), [float(np.float32(c)) for c in v], int(k)) for i, v, k in zip(rng.permutation(n), x, y, strict=True)]


ODD = [
    (None, [1.0] * 8, 1), (1_000, None, 1), (1_010, [1.0] * 8, None), (1_020, [1.0, None] + [0.0] * 6, 1), (1_030, [float("nan")] * 8, 1), (1_040, [float("inf")] + [0.0] * 7, 2),
    (1_050, [], 1), (1_060, [0.5, 0.5], 1), (1_070, [0.0] * 8, 0), (2_000, [1.0] * 8, 0), (2_000, [1.0] * 8, 0), (2_000, [1.0] * 8, 1), (2_000, [0.9] * 8, 0), (-10, [1.0] * 8, 3),
]


def test_against_brute_force(spark):
    rows = vectors(1, 400) + ODD
    want = plain(rows)
    assert len(want) > 100
    assert got(spark, rows) == want
    assert got(spark, rows, most=7) == want  # in blocks of anchors
    assert got(spark, rows, positives=2, negatives=1, low=10, high=99) == plain(rows, positives=2, negatives=1, low=10, high=99)


def test_copies_of_one_vector_tie_by_id(spark):
    rows = vectors(2, 150) + [(10_000 + i, [0.7] * 8, i % 2) for i in range(300)]
    assert got(spark, rows) == plain(rows)


def test_small_leaves_and_blocks(spark, monkeypatch):
    """Every node pair is looked at: trees of many levels, several blocks a task, no help from the sample."""
    rows = vectors(3, 300, spread=0.05)
    sound = sorted({(i, y, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, v, y in rows})
    every = hn.Rows(*(np.array([r[k] for r in sound], np.int64) for k in range(3)))
    anchors = every.take(np.flatnonzero(every.id % 10 == 0))
    n, far = len(anchors), np.full(len(anchors), 1 << 62)
    for same in (True, False):
        wanted = hn.Wanted(np.arange(n), -far, far, -far, 5, same)
        search = hn.Search(anchors, hn.Tree(anchors, 4, same), wanted, leaf=4)
        for at in range(0, len(every), 50):
            search.take(every.take(np.arange(at, min(at + 50, len(every)))))
        assert search.scored < n * len(every) / 2  # whole groups are pruned
        for k in range(n):
            score = every.vector @ anchors.vector[k]
            fits = (every.label == anchors.label[k]) == same
            fits &= every.id != anchors.id[k]
            want = sorted(zip(-score[fits], every.id[fits], strict=True))[:5]
            assert [(-s, i) for s, i in zip(search.best.score[k], search.best.id[k], strict=True)] == [tuple(w) for w in want]


def test_intervals_hold_all_products():
    rng = np.random.default_rng(4)
    a, b = (hn.Rows(np.arange(200), np.zeros(200, np.int64), rng.integers(-400, 400, (200, 6))) for _ in range(2))
    x, y = hn.Tree(a, 10), hn.Tree(b, 10)
    i, j = (k.ravel() for k in np.meshgrid(np.arange(len(x.start)), np.arange(len(y.start))))
    low, high = hn.intervals(x, i, y, j)
    for p, q, least, most in zip(i, j, low, high, strict=True):
        found = hn.products(a.vector[x.members(p)], b.vector[y.members(q)])
        assert least <= found.min() and found.max() <= most


def test_large_components_are_exact():
    a, b = np.array([[2**30, 3]]), np.array([[2**30 + 1, -5], [7, 2**29]])
    assert hn.products(a, b).tolist() == [[2**30 * (2**30 + 1) - 15, 7 * 2**30 + 3 * 2**29]]
    with pytest.raises(OverflowError):
        hn.products(np.array([[2**40]]), np.array([[2**40]]))


def test_no_rows_and_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(empty, F.col("id") % 10 == 0).count() == 0
    assert got(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == Counter()
    assert got(spark, [(10, [1.0], 1), (2, [0.9], 2)]) == Counter()  # no positive
