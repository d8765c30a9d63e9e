"""Hard negatives by dual-tree search.

A bounded sample gives a tree of splits that deals all candidates into cells; they are sorted by label and cell, so that a
partition's rows lie near each other. A task builds a tree over each block of its rows and walks it together with a tree over the anchors: a pair
of nodes has an interval that all inner products between their members lie in (from their boxes and from their balls, the
narrower of both), and a pair whose interval holds nothing that any anchor of the node still wants is dropped at once, with all
anchors in it. What is left are pairs of leaves, whose inner products are computed exactly, in whole numbers.

Anchors are a stated set of rows. They go against all rows in blocks of at most ANCHORS, each broadcast in its turn; what every
task keeps of a block are the best few of each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import calm, cut, fit_partitions, union, whole_number

#: Rows that the cells and the first bounds are made from, at most. Every row is dealt and searched, whatever it holds.
SAMPLE = 4_096
#: Anchors of a block, at most, and bytes of their vectors.
ANCHORS, ANCHOR_BYTES = 32_768, 64 << 20
#: Rows of candidates that a task holds as one tree, and members of a leaf of either tree.
BLOCK, LEAF = 16_384, 128
#: Cells that candidates are dealt into.
CELLS = 256
#: Inner products that one step of scoring holds.
CHUNK = 1 << 22
SCALE = 256


@dataclass
class Rows:
    """Ids, labels and vectors of whole numbers."""

    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray

    def __len__(self) -> int:
        return len(self.id)

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.id[at], self.label[at], self.vector[at])


def _as_rows(ids: pa.Array, labels: pa.Array, vectors: pa.ListArray, dim: int) -> Rows:
    """Shorter vectors count as if zeros followed."""
    n = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (n == dim).all():
        return Rows(ids.to_numpy(), labels.to_numpy(), flat.reshape(-1, dim))
    full = np.zeros((len(n), dim), np.int64)
    full[np.arange(dim) < n[:, None]] = flat
    return Rows(ids.to_numpy(), labels.to_numpy(), full)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; an error where they might not fit a long."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products of these vectors don't fit a long")
    return a @ b.T


class Tree:
    """Halves of rows, level by level: along the direction in which a node's members differ most, or by label first.

    Node k covers the rows order[start[k]:end[k]]; its children are child[k] and child[k] + 1, or none (0) for a leaf. Members
    of the first child have at most, those of the second at least `at[k]` in direction axis[k].
    """

    def __init__(self, rows: Rows, leaf: int = LEAF, by_label: bool = False):
        x = rows.vector.astype(np.float64)
        self.order = np.arange(len(rows))
        start, end, child, axis, at, label = [0], [len(rows)], [], [], [], []
        k = 0
        while k < len(start):
            a, b = start[k], end[k]
            mine = self.order[a:b]
            own, marks = x[mine], rows.label[mine]
            label.append((marks.min(), marks.max()) if b > a else (0, 0))
            child.append(len(start) if b - a > leaf else 0)
            axis.append(int(np.argmax(own.var(axis=0))) if child[k] and x.shape[1] else 0)
            at.append(0.0)
            if child[k]:
                value = marks if by_label and label[k][0] < label[k][1] or not x.shape[1] else own[:, axis[k]]
                half = (b - a) // 2
                by = np.argpartition(value, half)
                at[k] = float(value[by[half]])
                self.order[a:b] = mine[by]
                start += [a, a + half]
                end += [a + half, b]
            k += 1
        self.start, self.end, self.child, self.axis, self.at = np.array(start), np.array(end), np.array(child), np.array(axis), np.array(at)
        self.label = np.array(label, np.int64)
        n, dim = len(start), x.shape[1]
        self.low, self.high, self.center, self.radius = np.zeros((n, dim)), np.zeros((n, dim)), np.zeros((n, dim)), np.zeros(n)
        for k in range(n):
            own = x[self.members(k)]
            if len(own):
                self.low[k], self.high[k], self.center[k] = own.min(axis=0), own.max(axis=0), own.mean(axis=0)
                self.radius[k] = np.sqrt(((own - self.center[k]) ** 2).sum(axis=1).max())
        self.length = np.sqrt((self.center**2).sum(axis=1))

    def members(self, k: int) -> np.ndarray:
        return self.order[self.start[k] : self.end[k]]

    def route(self, vector: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls into."""
        node = np.zeros(len(vector), np.int64)
        while (inner := np.flatnonzero(self.child[node])).size:
            k = node[inner]
            node[inner] = self.child[k] + (vector[inner, self.axis[k]] >= self.at[k])
        return node


def intervals(a: Tree, i: np.ndarray, b: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of nodes, bounds of the inner products of their members: of boxes and of balls, the narrower; a little wider than both, for rounding."""
    al, ah, bl, bh = a.low[i], a.high[i], b.low[j], b.high[j]
    corners = (al * bl, al * bh, ah * bl, ah * bh)
    low, high = np.minimum.reduce(corners).sum(axis=1), np.maximum.reduce(corners).sum(axis=1)
    mid = (a.center[i] * b.center[j]).sum(axis=1)
    off = a.length[i] * b.radius[j] + a.radius[i] * b.length[j] + a.radius[i] * b.radius[j]
    low, high = np.maximum(low, mid - off), np.minimum(high, mid + off)
    slack = 1 + 1e-9 * (np.abs(mid) + off)
    return low - slack, high + slack


@dataclass
class Wanted:
    """What anchors look for: of each slot, the `most` best rows with low <= score <= high, of the anchor's label or of others.

    anchor[s] is the slot's anchor, in order. floor[s] is a bound that so many rows reach already, wherever they are:
    no row below it can matter.
    """

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    most: int
    same: bool


_FAR = np.int64(1) << 62


class Best:
    """The best rows of each slot so far: higher scores first, ties by smaller id."""

    def __init__(self, wanted: Wanted):
        n = len(wanted.anchor)
        self.wanted, self.floor = wanted, np.maximum(wanted.low, wanted.floor)
        self.score, self.id, self.count = np.full((n, wanted.most), -_FAR), np.zeros((n, wanted.most), np.int64), np.zeros(n, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, of: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        have = np.arange(self.wanted.most) < self.count[touched, None]
        slot = np.concatenate((slot, np.repeat(touched, self.wanted.most)[have.ravel()]))
        score, of = np.concatenate((score, self.score[touched][have])), np.concatenate((of, self.id[touched][have]))
        by = np.lexsort((of, -score, slot))
        slot, score, of = slot[by], score[by], of[by]
        begins = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(np.r_[begins, len(slot)]))
        kept = rank < self.wanted.most
        self.score[slot[kept], rank[kept]], self.id[slot[kept], rank[kept]] = score[kept], of[kept]
        self.count[touched] = np.minimum(np.diff(np.r_[begins, len(slot)]), self.wanted.most)
        full = touched[self.count[touched] == self.wanted.most]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, -1])


class Search:
    """Anchors in a tree, met by tree after tree of candidates. scored: inner products computed so far."""

    def __init__(self, anchors: Rows, tree: Tree, wanted: Wanted, leaf: int = LEAF):
        self.anchors, self.tree, self.best = anchors, tree, Best(wanted)
        self.leaf, self.scored = leaf, 0
        self.slots = np.searchsorted(wanted.anchor, np.arange(len(anchors) + 1))  # of each anchor

    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each node of anchors, the least score that one of its slots still takes, and the highest."""
        low, high = np.full(len(self.tree.start), _FAR, np.float64), np.full(len(self.tree.start), -_FAR, np.float64)
        first, last = np.full(len(self.anchors), _FAR, np.float64), np.full(len(self.anchors), -_FAR, np.float64)
        np.minimum.at(first, self.best.wanted.anchor, self.best.floor)
        np.maximum.at(last, self.best.wanted.anchor, self.best.wanted.high)
        for k in range(len(low)):
            at = self.tree.members(k)
            low[k], high[k] = first[at].min(initial=_FAR), last[at].max(initial=-_FAR)
        return low, high

    def take(self, rows: Rows) -> None:
        """Candidates, as one tree."""
        if not len(rows) or not len(self.anchors) or not len(self.best.floor):
            return
        other = Tree(rows, self.leaf, self.best.wanted.same)
        low, high = self._bounds()
        i, j, leaves = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(i):
            least, most = intervals(self.tree, i, other, j)
            a, b = self.tree.label[i], other.label[j]
            apart = (a[:, 1] < b[:, 0]) | (b[:, 1] < a[:, 0])
            one = (a[:, 0] == a[:, 1]) & (b[:, 0] == b[:, 1]) & (a[:, 0] == b[:, 0])
            go = (most >= low[i]) & (least <= high[i]) & ~(apart if self.best.wanted.same else one)
            i, j, most = i[go], j[go], most[go]
            ends = (self.tree.child[i] == 0) & (other.child[j] == 0)
            leaves += zip(most[ends].tolist(), i[ends].tolist(), j[ends].tolist(), strict=True)
            i, j = i[~ends], j[~ends]
            size_i, size_j = self.tree.end[i] - self.tree.start[i], other.end[j] - other.start[j]
            left = (self.tree.child[i] > 0) & ((size_i >= size_j) | (other.child[j] == 0))  # the larger node is split
            ci, cj = self.tree.child[i[left]], other.child[j[~left]]
            i, j = np.concatenate((ci, ci + 1, i[~left], i[~left])), np.concatenate((j[left], j[left], cj, cj + 1))
        leaves.sort(reverse=True)  # the most promising pairs first, so that floors rise early
        for most, i, j in leaves:
            self._score(i, rows, other.members(j), most)

    def _score(self, node: int, rows: Rows, at: np.ndarray, most: float) -> None:
        own = self.tree.members(node)
        begin, n = self.slots[own], self.slots[own + 1] - self.slots[own]
        slot = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        slot = slot[self.best.floor[slot] <= most]
        if not len(slot):
            return
        asked, place = np.unique(self.best.wanted.anchor[slot], return_inverse=True)
        some = rows.take(at)
        got = products(self.anchors.vector[asked], some.vector)
        self.scored += got.size
        alike = self.anchors.label[asked][:, None] == some.label
        fits = alike if self.best.wanted.same else ~alike
        if self.best.wanted.same:  # an anchor is not its own positive
            r, c = np.nonzero(self.anchors.id[asked][:, None] == some.id)
            fits[r, c] &= (self.anchors.vector[asked[r]] != some.vector[c]).any(axis=1)
        most_slots = max(1, CHUNK // len(at))
        for a in range(0, len(slot), most_slots):
            s, p = slot[a : a + most_slots], place[a : a + most_slots]
            each = got[p]
            r, c = np.nonzero(fits[p] & (each >= self.best.floor[s][:, None]) & (each <= self.best.wanted.high[s][:, None]))
            self.best.add(s[r], each[r, c], some.id[c])


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, most: int) -> Iterator[Rows]:
    """Consecutive rows, `most` at a time; columns id, label, vector."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            if size and size + part.num_rows > most:
                yield _joined(held, dim)
                held, size = [], 0
            held.append(part)
            size += part.num_rows
    if held:
        yield _joined(held, dim)


def _joined(parts: list[pa.RecordBatch], dim: int) -> Rows:
    return _as_rows(*(pa.concat_arrays([p.column(k) for p in parts]) for k in range(3)), dim)


def _collected(rows: DataFrame, dim: int) -> Rows:
    """A bounded number of rows, on the driver, each once, in order of id."""
    found = rows.select("id", "label", "vector").toArrow().combine_chunks()
    if not found.num_rows:
        return Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim), np.int64))
    got = _as_rows(*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.columns), dim)
    got = got.take(np.lexsort((*got.vector.T[::-1], got.label, got.id)))
    new = np.ones(len(got), bool)
    new[1:] = (got.id[1:] != got.id[:-1]) | (got.label[1:] != got.label[:-1]) | (got.vector[1:] != got.vector[:-1]).any(axis=1)
    return got.take(np.flatnonzero(new))


def prepared(rows: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """id, label, vector (each component times SCALE, floored) of the rows that take part, equal ones once."""
    x = F.col(f"`{vector}`")
    taken = rows.select(whole_number(rows, key).alias("id"), label.cast("bigint").alias("label"), x.cast("array<double>").alias("x")).where("id is not null and label is not null and x is not null")
    taken = taken.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    return taken.select("id", "label", F.transform("x", lambda c: F.floor(c * SCALE).cast("bigint")).alias("vector")).dropDuplicates()


def _top(dealt: DataFrame, anchors, wanted: Wanted, dim: int) -> DataFrame:
    """slot, id, score, rank: the best rows of each slot over all candidates; a task sends the best of its own."""
    sent = dealt.sparkSession.sparkContext.broadcast(wanted)  # as many slots as a block's anchors have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calm()
        search = Search(*anchors.value, sent.value)
        for rows in _blocks(batches, dim, BLOCK):
            search.take(rows)
        best = search.best
        slot, rank = np.nonzero(np.arange(sent.value.most) < best.count[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(best.id[slot, rank]), pa.array(best.score[slot, rank])], names=["slot", "id", "score"])

    hits = dealt.select("id", "label", "vector").mapInArrow(run, "slot bigint, id bigint, score bigint")
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted.most)


def _floors(dealt: DataFrame, anchors, sample, wanted: Wanted, n: int) -> np.ndarray:
    """Of each slot, the score that enough rows of the sample reach already; the anchors are dealt to tasks."""
    sent = dealt.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, w = anchors.value[0], sent.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            slots = np.flatnonzero(np.isin(w.anchor, own))
            some = every.take(own)
            part = Wanted(np.searchsorted(own, w.anchor[slots]), w.low[slots], w.high[slots], w.floor[slots], w.most, w.same)
            search = Search(some, Tree(some, LEAF, w.same), part)
            search.take(sample.value)
            full = np.flatnonzero(search.best.count == w.most)
            yield pa.RecordBatch.from_arrays([pa.array(slots[full]), pa.array(search.best.score[full, -1])], names=["slot", "floor"])

    spark = dealt.sparkSession
    found = spark.range(0, n, 1, max(1, min(fit_partitions(spark), n // 64))).mapInArrow(run, "slot bigint, floor bigint").toArrow()
    floor = wanted.floor.copy()
    floor[found.column("slot").to_numpy()] = found.column("floor").to_numpy()
    return floor


_OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(rows: DataFrame, anchors: Column, key: str = "vec_id", label: Column | None = None, vector: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, most: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of vectors of whole numbers (each component times SCALE, floored). An anchor (where the condition
    on `id` holds) has as positives its first `positives` other rows of its label, by score, then by id; for each, the first
    `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null key, label or vector, or with a null or non-finite component, take no part. Rows equal in key, label and
    vector count once; rows that share only the key are rows of their own. A shorter vector counts as if zeros followed.
    An empty table gives an empty one; other columns are left out, whatever their names. most: anchors of a block, which changes no result.
    """
    spark = rows.sparkSession
    all_rows = cut(prepared(rows, key, F.col("`label`") if label is None else label, vector))
    n, dim, n_anchors = all_rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.count_if(anchors)).first()
    if not n_anchors:
        return spark.createDataFrame([], _OUT)
    sample = _collected(all_rows.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE), dim)
    cells = spark.sparkContext.broadcast(Tree(sample, max(1, SAMPLE // CELLS)))
    sample_sent = spark.sparkContext.broadcast(sample)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _as_rows(*batch.columns, dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.value.route(got.vector).astype(np.int32))], names=["id", "label", "vector", "cell"])

    order = ["label", "cell", F.xxhash64("id", "vector")]
    placed = all_rows.mapInArrow(route, "id bigint, label bigint, vector array<bigint>, cell int")
    dealt = cut(placed.repartitionByRange(fit_partitions(spark), *order).sortWithinPartitions(*order).select("id", "label", "vector"))
    blocks = max(-(-n_anchors // most), -(-n_anchors * max(1, dim) * 8 // ANCHOR_BYTES))
    found = []
    for k in range(blocks):
        own = _collected(all_rows.where(anchors & (F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)) == k)), dim)  # a block of anchors
        if len(own):
            found.append(_mined(dealt, own, sample_sent, positives, negatives, low, high, dim))
    return union(found)


def _mined(dealt: DataFrame, own: Rows, sample, positives: int, negatives: int, low: int, high: int, dim: int) -> DataFrame:
    """The rows of hard_negatives() for a block of anchors."""
    context, n = dealt.sparkSession.sparkContext, len(own)
    none = np.full(n, -_FAR)
    wanted = Wanted(np.arange(n), none, np.full(n, _FAR), none, positives, True)
    anchors = context.broadcast((own, Tree(own, LEAF, True)))
    wanted.floor = _floors(dealt, anchors, sample, wanted, n)
    got = _top(dealt, anchors, wanted, dim).toArrow()  # a few rows an anchor
    by = np.lexsort((got.column("rank").to_numpy(), got.column("slot").to_numpy()))
    slot, positive, score = (got.column(c).to_numpy()[by] for c in ("slot", "id", "score"))
    least, last = -(-low * score // 100), high * score // 100
    some = least <= last
    slot, positive, score, least, last = slot[some], positive[some], score[some], least[some], last[some]
    if not len(slot):
        return dealt.sparkSession.createDataFrame([], _OUT)
    wanted = Wanted(slot, least, last, least, negatives, False)
    anchors = context.broadcast((own, Tree(own)))
    wanted.floor = _floors(dealt, anchors, sample, wanted, n)
    names = context.broadcast((own.id[slot], positive, score))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            anchor_id, positive_id, positive_score = (pa.array(x[at]) for x in names.value)
            yield pa.RecordBatch.from_arrays([anchor_id, positive_id, batch.column(3), batch.column(1), positive_score, batch.column(2)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return _top(dealt, anchors, wanted, dim).mapInArrow(named, _OUT)
