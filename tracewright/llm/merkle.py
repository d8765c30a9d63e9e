"""Merkle manifests of datasets, by mountain ranges over indexed partitions.

Rows are leaves: digests of their fields, made where the rows lie, so that no text shuffles. Leaves are dealt by ranges of
(group, key) and numbered within their group from the counts of the partitions. Each partition pushes its leaves on a stack of
mountains: `base` nodes of one run carry into their parent, as digits do; the completed peaks that no carry reaches any
more, for want of siblings in other partitions, are as many as a few times the height. Peaks meet by the subtree they lie in,
HEIGHT levels a round, never more than one subtree of that height in a task's hands; a last run that is shorter is hashed as it is, without
padding. Ways from peaks to the root come back to the partitions, which prolong them to every leaf.

A group's own root is a leaf of the tree over groups, which is built by the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby, pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import calm, cut, fit_partitions, union

BASE = 3
#: Levels that peaks climb in one round: a subtree has at most BASE ** HEIGHT nodes of its lowest level.
HEIGHT = 5
#: Bytes of a digest.
WIDE = 32


def joined(digests: bytes) -> bytes:
    """H of digests that lie one behind the other: the SHA-256 of their hex texts."""
    return hashlib.sha256(digests.hex().encode()).digest()


def leaf(*fields: Column) -> Column:
    """The digest of a row, as hex text: each field as its UTF-8 byte count, a colon and its text, or - if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def width(n: int, level: int, base: int) -> int:
    """Nodes of a level over n leaves."""
    for _ in range(level):
        n = -(-n // base)
    return n


def height(n: int, base: int) -> int:
    level = 0
    while n > 1:
        n, level = -(-n // base), level + 1
    return level


class Range:
    """The mountains over consecutive leaves first, first + 1, ... of a group of n; levels[l] is (index of the first node, digests).

    push() takes the next leaf; every carry makes one parent. A run whose first siblings lie before `first` is never
    complete here, nor is one whose last ones lie behind the last leaf pushed. The last run of a level is complete with the
    level's last node, as short as it is.
    """

    def __init__(self, first: int, n: int, base: int = BASE):
        self.base, self.n, self.top = base, n, height(n, base)
        self.widths = [width(n, k, base) for k in range(self.top + 1)]
        self.levels: list[tuple[int, bytearray]] = [(first, bytearray())]

    def _carry(self, level: int) -> None:
        while level < self.top:
            first, held = self.levels[level]
            index = first + len(held) // WIDE - 1  # of the newest node
            begins = index - index % self.base
            if (index + 1) % self.base and index + 1 != self.widths[level] or begins < first:
                return
            digest = joined(bytes(held[(begins - first) * WIDE :]))
            level += 1
            if level == len(self.levels):
                self.levels.append((index // self.base, bytearray()))
            self.levels[level][1].extend(digest)

    def push(self, digest: bytes) -> None:
        self.levels[0][1].extend(digest)
        self._carry(0)

    def nodes(self) -> Iterator[tuple[int, int, bytes]]:
        """All nodes as (level, index, digest)."""
        for level, (first, held) in enumerate(self.levels):
            for k in range(0, len(held), WIDE):
                yield level, first + k // WIDE, bytes(held[k : k + WIDE])

    def has(self, level: int, index: int) -> bool:
        return level < len(self.levels) and 0 <= index - self.levels[level][0] < len(self.levels[level][1]) // WIDE

    def peaks(self) -> list[tuple[int, int, bytes]]:
        """Nodes without a parent here: of each level those before its first complete run and those behind its last one."""
        found = []
        for level, (first, held) in enumerate(self.levels):
            last = first + len(held) // WIDE
            some = []
            if level + 1 < len(self.levels):
                up, above = self.levels[level + 1][0], len(self.levels[level + 1][1]) // WIDE
                some = [*range(first, up * self.base), *range(min(last, (up + above) * self.base), last)]
            else:
                some = range(first, last)
            found += [(level, i, bytes(held[(i - first) * WIDE : (i - first + 1) * WIDE])) for i in some]
        return found

    def way(self, level: int, index: int) -> tuple[int, int, bytes]:
        """The peak that a node lies under, and the steps up to it."""
        steps = bytearray()
        while self.has(level + 1, index // self.base):
            first, held = self.levels[level]
            begins = index - index % self.base
            count = min(self.base, self.widths[level] - begins)
            steps += step(index - begins, [bytes(held[(begins + k - first) * WIDE : (begins + k - first + 1) * WIDE]) for k in range(count)])
            level, index = level + 1, index // self.base
        return level, index, bytes(steps)


def step(place: int, run: list[bytes]) -> bytes:
    """One level of a way: the node's place in its run, the run's other nodes."""
    return bytes((place, len(run))) + b"".join(d for k, d in enumerate(run) if k != place)


def steps_of(way: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, the other nodes' digests) of each level."""
    at = 0
    while at < len(way):
        place, more = way[at], (way[at + 1] - 1) * WIDE
        yield place, way[at + 2 : at + 2 + more]
        at += 2 + more


def proof(way: bytes) -> str:
    """H of all siblings from the leaf to the root, level by level, left to right."""
    return hashlib.sha256("".join(others.hex() for _, others in steps_of(way)).encode()).hexdigest()


def fold(digest: bytes, way: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for place, others in steps_of(way):
        cut_at = place * WIDE
        digest = joined(others[:cut_at] + digest + others[cut_at:])
    return digest


_NODE = "g string, n bigint, top int, level int, index bigint, digest binary"
_PEAK = {"part": pa.int32(), "g": pa.string(), "n": pa.int64(), "top": pa.int32(), "level": pa.int32(), "index": pa.int64(), "digest": pa.binary()}
_CLIMBED = {k: v for k, v in _PEAK.items() if k != "part"} | {"own_level": pa.int32(), "own_index": pa.int64(), "way": pa.binary()}


def _batch(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, columns.values(), strict=True)], names=list(columns))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (g, digest and others) dealt by ranges of (g, *order) and sorted; kept, with each one's partition (part) and place in it (pos)."""
    by = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    dealt = rows.repartitionByRange(fit_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    return cut(dealt.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, str, Iterator[pa.RecordBatch]]]:
    """(part, g, its slices), one after the other, of batches that are sorted by part and g, their first two columns."""

    def pieces() -> Iterator[tuple[int, str, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, coded = batch.column(0).to_numpy(), batch.column(1).dictionary_encode()
            names, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(ids)]
            for a, b in pairwise(starts):
                yield int(part[a]), names[ids[a]], batch.slice(a, b - a)

    for (part, g), found in groupby(pieces(), lambda x: x[:2]):
        yield part, g, (x[2] for x in found)


def _places(rows: DataFrame) -> dict[tuple[int, str], tuple[int, int]]:
    """Of the first and the last group of each partition: the index of its first row there in its group, and the group's size.

    A group between these two lies in that partition alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for part, g, slices in _runs(batches):
            last = (part, g, sum(x.num_rows for x in slices))
            first = first or last
        if first:
            yield _batch({"part": pa.int32(), "first": pa.string(), "n_first": pa.int64(), "last": pa.string(), "n_last": pa.int64()}, [(*first, *last[1:])])

    edges = rows.select("part", "g").mapInArrow(run, "part int, first string, n_first bigint, last string, n_last bigint").collect()  # one row a partition
    total: dict[str, int] = {}
    start = {}
    for part, first, n_first, last, n_last in sorted(tuple(e) for e in edges):
        start[part, first] = total.get(first, 0)
        total[first] = total.get(first, 0) + n_first
        if last != first:
            start[part, last], total[last] = 0, n_last
    return {(part, g): (at, total[g]) for (part, g), at in start.items()}


def _built(place: tuple[int, int] | None, slices: Iterable[pa.RecordBatch], base: int) -> tuple[Range, list[pa.RecordBatch]]:
    """The mountains over a partition's leaves of a group, and their slices; a slice's third column is the digest."""
    held = list(slices)
    first, n = place or (0, sum(x.num_rows for x in held))
    made = Range(first, n, base)
    for x in held:
        for d in x.column(2).to_pylist():
            made.push(d)
    return made, held


def _found(rows: DataFrame, places: Any, base: int, what: Callable[[Range], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
    """part and _NODE's columns: what the mountains over each group of each partition give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calm()
        out: list[tuple] = []
        for part, g, slices in _runs(batches):
            made, _ = _built(places.value.get((part, g)), slices, base)
            for node in what(made):
                out.append((part, g, made.n, made.top, *node))
                if len(out) == 4_096:
                    yield _batch(_PEAK, out)
                    out = []
        yield _batch(_PEAK, out)

    return rows.select("part", "g", "digest").mapInArrow(run, f"part int, {_NODE}")


def climb(known: list[tuple[int, int, bytes]], n: int, upto: int, base: int) -> list[tuple]:
    """Of the peaks of one subtree: level, index and digest of the node they all end in, and each one's own place and way there.

    `known` holds every peak of the subtree under one node of level `upto`, or under the root if that is lower.
    """
    digest = {(level, index): d for level, index, d in known}
    top = min(upto, height(n, base))
    wide = [width(n, k, base) for k in range(top + 1)]
    for level in range(min(k[0] for k in digest), top):
        for up in {i // base for k, i in digest if k == level}:
            run = range(up * base, min((up + 1) * base, wide[level]))
            digest[level + 1, up] = joined(b"".join(digest[level, i] for i in run))
    found = []
    for level, index, _ in known:
        at, i, way = level, index, bytearray()
        while at < top:
            begins = i - i % base
            way += step(i - begins, [digest[at, k] for k in range(begins, min(begins + base, wide[at]))])
            at, i = at + 1, i // base
        found.append((at, i, digest[at, i], level, index, bytes(way)))
    return found


def _round(peaks: DataFrame, upto: int, base: int) -> DataFrame:
    """_CLIMBED's columns: peaks of levels upto - HEIGHT to upto - 1, met by the subtree under level `upto` that they lie in.

    A subtree has at most BASE ** HEIGHT + ... peaks, so a group stays small however large its dataset is.
    """
    under = reduce(lambda c, k: F.when(F.col("level") == k, F.expr(f"index div {base ** (upto - k)}")).otherwise(c), range(max(0, upto - HEIGHT), upto), F.lit(None).cast("bigint"))

    def run(key: tuple, found: pa.Table) -> pa.Table:
        n, top = found.column("n")[0].as_py(), found.column("top")[0].as_py()
        known = list(zip(*(found.column(c).to_pylist() for c in ("level", "index", "digest")), strict=True))
        return pa.Table.from_batches([_batch(_CLIMBED, [(key[0].as_py(), n, top, *x) for x in climb(known, n, upto, base)])])

    return peaks.withColumn("under", under).groupBy("g", "under").applyInArrow(run, f"{_NODE}, own_level int, own_index bigint, way binary")


def forest(rows: DataFrame, order: list[str], base: int = BASE) -> tuple[DataFrame, DataFrame, DataFrame, Any]:
    """Trees over rows (g, digest and others), one for each g, their leaves in the order of the columns named.

    Gives the rows as they were dealt, the ways of the partitions' peaks (part, g, level, index, way up to the group's root),
    the roots (g, n, digest), and what `prolonged` needs besides: where partitions begin. The driver sees one row a partition
    and the height.
    """
    rows = _numbered(rows, order)
    places = rows.sparkSession.sparkContext.broadcast(_places(rows))  # four numbers a partition
    peaks = cut(_found(rows, places, base, Range.peaks))
    top = peaks.agg(F.max("top")).first()[0] or 0
    names = [c for c in _PEAK if c != "part"]
    now, ways = peaks.select(names), peaks.select("part", "g", "level", "index", F.col("level").alias("at"), F.col("index").alias("place"), F.lit(b"").alias("way"))
    for upto in [*range(HEIGHT, top, HEIGHT), top] if top else []:
        rises = (F.col("level") < upto) & (F.col("level") < F.col("top"))
        climbed = cut(_round(now.where(rises), upto, base))
        now = now.where(~rises).unionByName(climbed.select(names).distinct())
        up = climbed.select("g", F.col("own_level").alias("at"), F.col("own_index").alias("place"), F.col("level").alias("to_level"), F.col("index").alias("to_index"), F.col("way").alias("more"))
        ways = ways.join(up, ["g", "at", "place"], "left").select(
            "part", "g", "level", "index", F.coalesce("to_level", "at").alias("at"), F.coalesce("to_index", "place").alias("place"), F.concat("way", F.coalesce("more", F.lit(b""))).alias("way")
        )
    return rows, ways.drop("at", "place"), now.select("g", "n", "digest"), places


def prolonged(rows: DataFrame, ways: DataFrame, places: Any, keep: list[str], make: Callable[[bytes, bytes, tuple, tuple], tuple], schema: str, base: int = BASE) -> DataFrame:
    """What `make` gives for each leaf from its digest, its way to the root, its columns `keep`, and its peak's further columns.

    rows and ways: as forest() gives them, ways with any further columns. Both meet by the number of their partition, so every
    task has the leaves of one partition in order, and before them its few peaks.
    """
    more = [c for c in ways.columns if c not in ("part", "g", "level", "index", "way")]
    spot = {"level": "int", "index": "bigint", "way": "binary"} | {c: ways.schema[c].dataType for c in more}
    own = {"digest": "binary"} | {c: rows.schema[c].dataType for c in keep if c != "digest"}
    order = ["part", "g", *own, *spot, "pos"]
    leaves = rows.withColumns({c: F.lit(None).cast(t) for c, t in spot.items()}).select(order)
    peaks = ways.withColumns({c: F.lit(None).cast(t) for c, t in own.items()} | {"pos": F.lit(-1).cast("bigint")}).select(order)
    parts = max(1, rows.rdd.getNumPartitions())
    types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}
    met = leaves.unionByName(peaks).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calm()
        known: dict[tuple, tuple] = {}

        def only_leaves() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                is_peak = pc.less(batch.column(len(order) - 1), 0)
                for r in batch.filter(is_peak).to_pylist():
                    known[r["part"], r["g"], r["level"], r["index"]] = (r["way"], tuple(r[c] for c in more))
                yield batch.filter(pc.invert(is_peak))

        for part, g, slices in _runs(only_leaves()):
            made, held = _built(places.value.get((part, g)), slices, base)
            i = made.levels[0][0]
            for x in held:
                columns = [x.column(x.schema.get_field_index(c)).to_pylist() for c in keep]
                out = []
                for d, *kept in zip(x.column(2).to_pylist(), *columns, strict=True):
                    level, index, local = made.way(0, i)
                    way, with_peak = known[part, g, level, index]
                    out.append(make(d, local + way, tuple(kept), with_peak))
                    i += 1
                yield _batch(types, out)

    return met.mapInArrow(run, schema)


def _leaves(docs: DataFrame, fields: list[str], group: str, key: str, altered: dict[str, Column] | None) -> DataFrame:
    """g, key, digest, other (the digest of the altered row, null where it is the same). A null group sorts before all others."""
    own = leaf(*(F.col(f"`{c}`") for c in fields))
    other = leaf(*(altered.get(c, F.col(f"`{c}`")) for c in fields)) if altered else own
    g = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = docs.select(g.alias("g"), F.col(f"`{key}`").alias("key"), F.unhex(own).alias("digest"), (F.unhex(other) if altered else F.lit(None).cast("binary")).alias("other"))
    return rows.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other")))


def _over_groups(roots: DataFrame, base: int) -> DataFrame:
    """name, digest, way, root: of each group, in the tree over the groups' roots."""
    rows, ways, top, places = forest(roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"], base)
    ways = ways.join(F.broadcast(top.select("g", F.col("digest").alias("root"))), "g")  # one row
    return prolonged(rows, ways, places, ["name"], lambda d, way, kept, more: (*kept, d, way, *more), "name string, digest binary, way binary, root binary", base)


def node_records(docs: DataFrame, fields: list[str], group: str = "source", key: str = "doc_id", base: int = BASE) -> DataFrame:
    """The manifest's nodes below the tree over groups: group, n, level, index, digest (hex), each node once, leaves at level 0.

    Nodes that one partition completes come from there, the others from the rounds in which peaks meet. Nulls, ties and
    repeats as in `proofs`; an empty table gives an empty one.
    """
    rows = _numbered(_leaves(docs, fields, group, key, None), ["key", "digest"])
    places = rows.sparkSession.sparkContext.broadcast(_places(rows))
    local = _found(rows, places, base, Range.nodes).drop("part")
    peaks = cut(_found(rows, places, base, Range.peaks)).drop("part")
    top = peaks.agg(F.max("top")).first()[0] or 0
    now, found = peaks, [local]
    for upto in range(1, top + 1):
        up = F.expr(f"index div {base}")
        rises = (F.col("level") == upto - 1) & (F.col("level") < F.col("top"))
        runs = now.where(rises).groupBy("g", "n", "top", up.alias("index")).agg(F.array_sort(F.collect_list(F.struct("index", F.hex("digest").alias("d")))).alias("run"))  # `base` rows at most
        parents = cut(runs.select("g", "n", "top", F.lit(upto).alias("level"), "index", F.unhex(F.sha2(F.lower(F.concat_ws("", "run.d")), 256)).alias("digest")))
        found.append(parents)
        now = now.where(~rises).unionByName(parents)
    name = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group)
    return union(found).select(name, "n", "level", "index", F.lower(F.hex("digest")).alias("digest"))


def manifest(docs: DataFrame, fields: list[str], group: str = "source", key: str = "doc_id", base: int = BASE) -> DataFrame:
    """One row a group: group, n (rows), subroot and root (hex). Two datasets are equal when their roots are, and where groups differ, their subroots do."""
    _, _, roots, _ = forest(_leaves(docs, fields, group, key, None), ["key", "digest"], base)
    roots = cut(roots)
    over = _over_groups(roots, base)
    name = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group)
    return roots.join(over.select(F.col("name").alias("g"), "root"), "g").select(name, "n", F.lower(F.hex("digest")).alias("subroot"), F.lower(F.hex("root")).alias("root"))


def proofs(docs: DataFrame, fields: list[str], group: str = "source", key: str = "doc_id", base: int = BASE, altered: dict[str, Column] | None = None) -> DataFrame:
    """Per row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the row's fields. Leaves of a group (column `group`, null is a group of its own, before all
    others) ascend by key, null keys first; rows with one key ascend by their leaf, and equal rows are equal leaves side by
    side. Every `base` nodes give a parent, a shorter last run too, until one is left; the groups' roots, ordered by the bytes
    of the group's name, give the root in the same way. proof_sha256 is of all siblings on the way, folded_root what the leaf and they give;
    where `altered` gives another value for a field, that of the altered row. An empty table gives an empty one; columns that
    aren't named are left out, whatever their names.
    """
    rows, ways, roots, places = forest(_leaves(docs, fields, group, key, altered), ["key", "digest"], base)
    over = _over_groups(cut(roots), base).select(F.col("name").alias("g"), F.col("digest").alias("subroot"), F.col("way").alias("up"), "root")
    ways = ways.join(over, "g").select("part", "g", "level", "index", F.concat("way", "up").alias("way"), "subroot", "root")

    def make(digest: bytes, way: bytes, kept: tuple, more: tuple) -> tuple:
        own, other = kept
        folded = fold(other or digest, way)
        return own, digest.hex(), more[0].hex(), more[1].hex(), proof(way), folded.hex(), folded == more[1]

    kind = docs.schema[key].dataType.simpleString()
    found = prolonged(rows, ways, places, ["key", "other"], make, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", base)
    return found.withColumnRenamed("key", key)
