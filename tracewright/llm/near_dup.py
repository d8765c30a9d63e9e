"""N-gram Jaccard join by grouped prefixes, exact.

1. Every text becomes the set of its distinct word n-grams, as hashes. Texts with one set are one class: copies stand for
   each other. Hashes in over HEAVY of a batch's texts are counted over all; those in over HEAVY of all texts come last in
   the order (their number is bounded by the mean set size over HEAVY, whatever the input's size).
2. All other hashes are counted, by ranges of hashes, in packed sorted blocks; a class gets back its hashes that
   another class has too. The order of the join is that of the counts, so a class whose prefix holds only hashes of its
   own can link with nothing and is done. The prefix of n hashes has n - ceil(t n) + 1 of them.
3. Classes with the same (shared) prefix and size are one group. Groups that share a hash of their prefixes meet at the least
   group of that hash. A place of many members is cut into tiles, and each tile meets by itself and with one member of the
   place. Only members that this does not join to that one meet the other tiles: of near copies, few or none.
4. Where groups meet, pairs of groups are filtered by size and by the overlap that their prefixes allow, then expanded, and
   their members are verified on the whole sets. Links that join what is joined already are not written, so a place
   writes fewer links than it has members; connected components over all places give each document's class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, fit_partitions, fresh, map_arrow, release, slices, whole_number
from .components import components

WORDS, PERCENT = 4, 85
#: Share of texts from which a hash is heavy, and the least number of texts in a batch.
HEAVY, LEAST_HEAVY = 0.005, 24
#: Hashes that a task gathers before it writes blocks; bytes of text that are hashed at once.
BLOCK, BYTES = 3_000_000, 1 << 20
#: Members of a place that meet in one task with one of them, members of a tile beyond that, and hashes of either.
STAR_MEMBERS, TILE_MEMBERS, TILE_HASHES = 128, 4_096, 2_000_000
#: Rows up to which a set of identifiers is broadcast.
SMALL = 500_000

U = np.uint64
_GOLD, _SALT = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_DOC = "kind int, part int, doc_id bigint, n bigint, s1 bigint, s2 bigint, payload binary"


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * _GOLD
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: is it white, and its value with A-Z lower-cased."""
    white = np.zeros(256, bool)
    white[[32, *range(9, 14)]] = True
    low = np.arange(256)
    low[65:91] += 32
    return white, mix(low.astype(U) + U(1))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of raw."""
    white_of, value_of = _tables()
    data = np.frombuffer(raw, np.uint8)
    inside = ~white_of[data]
    start = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(start):
        return np.empty(0, U), start
    at = np.flatnonzero(inside)
    size = np.add.reduceat(inside, start, dtype=np.int64)
    offset = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    power = np.full(int(size.max()), _SALT, U)
    power[0] = U(1)
    power = np.multiply.accumulate(power)
    h = np.add.reduceat(value_of[data[at]] * power[offset], np.cumsum(size) - size)
    return mix(h + size.astype(U)), start


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; fewer words than n are one; no words, none."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    h, start = word_hashes(b"\n".join(raw))
    border = np.cumsum([0, *(len(r) + 1 for r in raw)])
    cuts = np.searchsorted(start, border)
    if len(h) >= words:
        gram = np.full(len(h) - words + 1, U(words), U)
        for k in range(words):
            gram = mix(gram * _SALT + h[k : k + len(gram)])
    found = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= words:
            found.append(np.unique(gram[a : b - words + 1]))
        elif b > a:
            one = np.full(1, U(b - a), U)
            for x in h[a:b]:
                one = mix(one * _SALT + x)
            found.append(one)
        else:
            found.append(np.empty(0, U))
    return found


def signature(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed integers."""
    return int(mix(s ^ _GOLD).sum(dtype=U).astype(np.int64)), int(mix(s * _SALT + U(3)).sum(dtype=U).astype(np.int64))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n // 100) + 1


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    for part in slices(batches, "text", BYTES):
        yield part.column(0).to_pylist(), shingle_sets([x or "" for x in part.column(1).to_pylist()], words)


def _gathered(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Sets in blocks of about BLOCK hashes, 60,000 texts at most and a slice."""
    ids, sets, size = [], [], 0
    for i, s in _sets(batches, words):
        ids += i
        sets += s
        size += sum(map(len, s))
        if size >= BLOCK or len(ids) > 60_000:
            yield ids, sets
            ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _rows(kind: int, part: list[int], doc_id: list | None = None, n: list | None = None, s1: list | None = None, s2: list | None = None, payload: list | None = None) -> pa.RecordBatch:
    size = len(part)
    column = lambda x, t: pa.array(x, t) if x is not None else pa.nulls(size, t)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size, pa.int32()), pa.array(part, pa.int32()), *(column(x, pa.int64()) for x in (doc_id, n, s1, s2)), column(payload, pa.binary())],
        names=["kind", "part", "doc_id", "n", "s1", "s2", "payload"],
    )


def described(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Kind 0: doc_id, n and signature of each row; kind 1: s1 a hash and n the texts of a batch that hold it, where these are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for ids, sets in _gathered(batches, words):
            both = [signature(s) for s in sets]
            yield _rows(0, [0] * len(ids), ids, [len(s) for s in sets], [b[0] for b in both], [b[1] for b in both])
            one = list({b: s for b, s in zip(both, sets, strict=True)}.values())
            h, count = np.unique(np.concatenate(one), return_counts=True)
            many = count >= max(LEAST_HEAVY, HEAVY * len(one))
            if many.any():
                yield _rows(1, [0] * int(many.sum()), n=count[many].tolist(), s1=h[many].astype(np.int64).tolist())

    return docs.mapInArrow(run, _DOC)


Name = tuple[int, int]
_NAME = np.dtype([("s1", "<i8"), ("s2", "<i8")])


def _blocks(docs: DataFrame, heavy, parts: int, words: int, percent: int) -> DataFrame:
    """Kind 2: a packed block of (class, hash) for a range of hashes; kind 3: a class's heavy hashes (all of them only if its
    prefix may need them); kind 6: how many of a class's hashes fall together when they are cut short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hot = heavy.value
        for _, sets in _gathered(batches, words):
            one = [(k, s) for k, s in {signature(s): s for s in sets if len(s)}.items()]
            if not one:
                continue
            kept, held, lost = [], ([], [], []), ([], [])
            for k, s in one:
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    if is_hot.any():
                        n, h = len(s), int(is_hot.sum())
                        held[0].append(k)
                        held[1].append(h)
                        held[2].append(s[is_hot].tobytes() if n - h < prefix_size(n, percent) else b"")
                        s = s[~is_hot]
                short = s >> U(16)  # 48 bits do for counts and order; sorted as s is
                if len(short) > 1 and (same := int((short[1:] == short[:-1]).sum())):
                    short = np.unique(short)
                    lost[0].append(k)
                    lost[1].append(same)
                kept.append(short)
            for kind, names, n, payload in ((3, held[0], held[1], held[2]), (6, lost[0], lost[1], None)):
                if names:
                    yield _rows(kind, [bucket(k[0], parts) for k in names], n=n, s1=[k[0] for k in names], s2=[k[1] for k in names], payload=payload)
            of = np.repeat(np.arange(len(one), dtype=np.uint32), [len(s) for s in kept])
            h = np.concatenate(kept)
            order = np.argsort(h, kind="stable")
            h, of = h[order], of[order]
            name = np.array([k for k, _ in one], _NAME)
            cuts = np.searchsorted(h, np.array([(p << 48) // parts for p in range(parts + 1)], U))
            at, payload = [], []
            for p in range(parts):
                a, b = cuts[p], cuts[p + 1]
                if a < b:
                    own, local = np.unique(of[a:b], return_inverse=True)
                    payload.append(_packed(name[own], local, h[a:b]))
                    at.append(p)
            yield _rows(2, at, payload=payload)

    return docs.mapInArrow(run, _DOC)


def bucket(s1: int, parts: int) -> int:
    """The bucket of a class, by the upper half of the first half of its name."""
    return ((s1 & ((1 << 64) - 1)) >> 32) * parts >> 32


def _packed(names: np.ndarray, local: np.ndarray, h: np.ndarray, df: np.ndarray | None = None) -> bytes:
    """A table of names, and of each entry the place of its name, its hash of 48 bits and, where given, its count."""
    wide = "<u2" if len(names) <= 1 << 16 else "<u4"
    entry = [(h >> U(16)).astype("<u4").tobytes(), (h & U(0xFFFF)).astype("<u2").tobytes(), local.astype(wide).tobytes()]
    return b"".join((len(names).to_bytes(4, "little"), len(h).to_bytes(4, "little"), names.tobytes(), *entry, b"" if df is None else df.astype("<u4").tobytes()))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Names, and of each entry the place of its name, its hash and its count."""
    k, m = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    at, wide = 8 + 16 * k, 2 if k <= 1 << 16 else 4
    h = np.frombuffer(raw, "<u4", m, at).astype(U) << U(16) | np.frombuffer(raw, "<u2", m, at + 4 * m).astype(U)
    at += 6 * m
    local = np.frombuffer(raw, f"<u{wide}", m, at)
    at += wide * m
    return np.frombuffer(raw, _NAME, k, 8), local, h, np.frombuffer(raw, "<u4", m, at) if at < len(raw) else None


class _Entries:
    """Entries of many packed blocks, with one number for each name."""

    def __init__(self):
        self.tables, self.locals, self.hashes, self.counts, self.n = [], [], [], [], 0

    def add(self, raw: bytes) -> None:
        names, local, h, df = _unpack(raw)
        self.tables.append(names)
        self.locals.append(local.astype(np.int64) + self.n)
        self.hashes.append(h)
        self.counts.append(df)
        self.n += len(names)

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Names, and of all entries the number of the name, the hash and the count."""
        if not self.tables:
            return np.empty(0, _NAME), np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64)
        every = np.concatenate(self.tables)
        order = np.lexsort((every["s2"], every["s1"]))
        of = every[order]
        new = np.ones(len(of), bool)
        new[1:] = (of["s1"][1:] != of["s1"][:-1]) | (of["s2"][1:] != of["s2"][:-1])
        number = np.empty(len(of), np.int64)
        number[order] = np.cumsum(new) - 1
        found = of[new], number[np.concatenate(self.locals)], np.concatenate(self.hashes), np.concatenate(self.counts).astype(np.int64) if self.counts[0] is not None else None
        self.tables, self.locals, self.hashes, self.counts = [], [], [], []
        return found


def _counted(blocks: DataFrame, parts: int) -> DataFrame:
    """Of each range: what the classes share with others, as kind 4 (class, hash, count), dealt by class; kinds 3 and 6 go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        entries = _Entries()
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if (kinds != 2).any():
                yield batch.filter(pa.array(kinds != 2))
            for raw in batch.filter(pa.array(kinds == 2)).column(6).to_pylist():
                entries.add(raw)
        names, of, h, _ = entries.all()
        if not len(names):
            return
        order = np.lexsort((of, h))
        of, h = of[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])  # a class counts once
        of, h = of[new], h[new]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        count = np.diff(np.append(np.flatnonzero(first), len(h)))
        df = np.repeat(count, count)
        shared = df >= 2
        of, h, df = of[shared], h[shared], df[shared]
        to = (((names["s1"].astype(U) >> U(32)) * U(parts)) >> U(32)).astype(np.int64)[of]
        order = np.argsort(to, kind="stable")
        of, h, df, to = of[order], h[order], df[order], to[order]
        cuts = np.searchsorted(to, np.arange(parts + 1))
        at, payload = [], []
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a < b:
                own, local = np.unique(of[a:b], return_inverse=True)
                payload.append(_packed(names[own], local, h[a:b], df[a:b]))
                at.append(p)
        if at:
            yield _rows(4, at, payload=payload)

    return blocks.mapInArrow(run, _DOC)


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """h, g, s1, s2 and n: the shared hashes in the prefix of each class that may link with another one, and its group.

    rows: kinds 3, 4 and 6, and kind 5 for each class: its name and n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[Name, tuple[int, bytes]] = {}
        size: dict[Name, int] = {}
        lost: dict[Name, int] = {}
        entries = _Entries()
        for batch in batches:
            for kind, n, s1, s2, raw in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6)), strict=True):
                if kind == 3:
                    held[s1, s2] = (n, raw)
                elif kind == 5:
                    size[s1, s2] = n
                elif kind == 6:
                    lost[s1, s2] = n
                else:
                    entries.add(raw)
        names, of, h, df = entries.all()
        order = np.lexsort((h, df, of))
        of, h = of[order], h[order]
        cuts = np.searchsorted(of, np.arange(len(names) + 1))
        spans = {k: (int(a), int(b)) for k, a, b in zip(names.tolist(), cuts[:-1], cuts[1:], strict=True)}
        out: tuple[list, ...] = ([], [], [], [], [])
        for k in spans.keys() | held.keys():
            n = size[k]
            a, b = spans.get(k, (0, 0))
            hot, raw = held.get(k, (0, b""))
            need = prefix_size(n, percent) - (n - lost.get(k, 0) - (b - a) - hot)  # hashes of its own come first
            if need <= 0:
                continue
            own = h[a : min(b, a + need)]
            if need > b - a:
                own = np.concatenate((own, (np.frombuffer(raw, U) >> U(16))[: need - (b - a)] | U(1 << 62)))
            if not len(own):
                continue
            group = int(mix(np.sort(own) + U(n)).sum(dtype=U).astype(np.int64)) ^ n
            for column, x in zip(out, (own.astype(np.int64).tolist(), [group] * len(own), [k[0]] * len(own), [k[1]] * len(own), [n] * len(own)), strict=True):
                column += x
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["h", "g", "s1", "s2", "n"])

    return rows.mapInArrow(run, "h bigint, g bigint, s1 bigint, s2 bigint, n bigint")


def _places(prefixes: DataFrame) -> DataFrame:
    """place, s1, s2, n: where each class meets others, two at least."""
    groups = prefixes.select("h", "g").distinct()
    lists = groups.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("g").alias("place")).where("k > 1").select("h", "place")
    meet = groups.join(lists, "h").select("g", "place").distinct()
    members = prefixes.select("g", *NODE, "n").distinct()
    alone = members.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g", F.col("g").alias("place"))
    return members.join(meet.unionByName(alone).distinct(), "g").select("place", *NODE, "n")


NODE = ["s1", "s2"]
_TILES = ["place", "tile_a", "tile_b"]


def _tile(tiles: Column) -> Column:
    return F.pmod(F.xxhash64(*NODE), tiles).cast("int")


def _tiles(members: str, of: int | Column) -> Column:
    return F.greatest(F.ceil(F.col(members) / of), F.ceil(F.col("w") / TILE_HASHES)).cast("int")


def _stars(places: DataFrame) -> DataFrame:
    """place, tiles, the class's name and side: each tile by itself and, where there are several, with the place's least member (side 1)."""
    sizes = places.groupBy("place").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.min(F.struct(*NODE)).alias("lead"))
    several = cut(sizes.select("place", "lead", _tiles("m", STAR_MEMBERS).alias("tiles")).where("tiles > 1"))
    own = places.join(_small(several.select("place", "tiles")), "place", "left")  # members of one place stay where they are
    own = own.select("place", F.coalesce(_tile(F.col("tiles")), F.lit(0)).alias("tile_a"), *NODE, F.lit(0).alias("side"))
    lead = several.select("place", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile_a"), "lead.s1", "lead.s2", F.lit(1).alias("side"))
    return own.unionByName(lead).select("place", "tile_a", F.lit(-1).alias("tile_b"), *NODE, "side")


def _crossings(places: DataFrame, left: DataFrame) -> DataFrame:
    """As _stars: the members that are left (side 1), in tiles, with all tiles of their place (side 0).

    The fewer are left, the smaller are the place's tiles, down to STAR_MEMBERS: copies of those left are as many as the members, or few.
    """
    left = left.select("place", *NODE).distinct()
    some = left.groupBy("place").agg(F.count(F.lit(1)).alias("u"))
    sizes = places.join(_small(cut(some)), "place").groupBy("place").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.max("u").alias("u"))
    sizes = _small(cut(sizes.select("place", _tiles("u", TILE_MEMBERS).alias("tiles_a"), _tiles("m", F.least(F.greatest("u", F.lit(STAR_MEMBERS)), F.lit(TILE_MEMBERS))).alias("tiles_b"))))
    each = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    asking = left.join(sizes, "place").select("place", _tile(F.col("tiles_a")).alias("tile_a"), each("tiles_b").alias("tile_b"), *NODE, F.lit(1).alias("side"))
    asked = places.join(sizes, "place").select("place", each("tiles_a").alias("tile_a"), _tile(F.col("tiles_b")).alias("tile_b"), *NODE, F.lit(0).alias("side"))
    return asking.unionByName(asked)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def verified(sets: list[np.ndarray], side: np.ndarray | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets that join what no link has joined yet. side: only pairs across sides count, unless None.

    Sets with one prefix and size are a group; pairs of groups that share no prefix hash, or whose sizes or prefixes leave
    too little overlap, go; the members of the others are counted over their whole sets.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    _, h = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    df = np.bincount(h)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))  # rarest here first
    r = rank[h]
    order = np.lexsort((r, owner))
    r = r[order]
    begin = np.concatenate(([0], np.cumsum(size)))
    depth = np.array([prefix_size(int(n), percent) for n in size])
    groups: dict[tuple[int, bytes], list[int]] = {}
    for i in range(m):
        groups.setdefault((int(size[i]), r[begin[i] : begin[i] + depth[i]].tobytes()), []).append(i)
    group_of = np.empty(m, np.int64)
    lead = []
    for g, members in enumerate(groups.values()):
        group_of[members] = g
        lead.append(members[0])
    lead = np.array(lead)
    count = len(lead)
    # postings of prefixes over groups, of whole sets over members
    p_rank = np.concatenate([r[begin[i] : begin[i] + depth[i]] for i in lead])
    p_group = np.repeat(np.arange(count), depth[lead])
    by = np.argsort(p_rank, kind="stable")
    p_group, p_at = p_group[by], np.searchsorted(p_rank[by], np.arange(len(df) + 1))
    by = np.argsort(r, kind="stable")
    w_owner, w_at = owner[by], np.searchsorted(r[by], np.arange(len(df) + 1))
    last = np.array([r[begin[i] + depth[i] - 1] for i in lead])  # of each group's prefix
    union, links = Union(m), []
    members_of = list(groups.values())

    def counts(ranks: np.ndarray, at: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
        width = at[ranks + 1] - at[ranks]
        total = int(width.sum())
        index = np.repeat(at[ranks] - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(total)
        return np.bincount(who[index], minlength=n)

    for g in range(count):
        i = int(lead[g])
        n = size[i]
        own = r[begin[i] : begin[i] + depth[i]]
        common = counts(own, p_at, p_group, count)
        sizes = size[lead]
        fits = (common > 0) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & (np.arange(count) <= g)
        if len(members_of[g]) == 1:
            fits[g] = False
        near = np.flatnonzero(fits)
        if not len(near):
            continue
        # beyond the smaller of the two last prefix hashes, a set has at most the rest of its hashes in common
        known = np.searchsorted(own, last[near], "right")
        theirs = np.array([np.searchsorted(r[begin[k] : begin[k] + depth[k]], own[-1], "right") for k in lead[near]])
        most = common[near] + np.minimum(n - known, sizes[near] - theirs)
        near = near[most * (100 + percent) >= percent * (n + sizes[near])]
        if not len(near):
            continue
        candidate = np.zeros(count, bool)
        candidate[near] = True
        who = np.flatnonzero(candidate[group_of])
        for x in members_of[g]:
            root = union.find(x)
            pick = who[who != x] if side is None else who[(side[who] != side[x]) & (who != x)]
            if not len(pick):
                continue
            overlap = counts(r[begin[x] : begin[x + 1]], w_at, w_owner, m)[pick]
            hit = pick[100 * overlap >= percent * (size[x] + size[pick] - overlap)]
            for y in hit.tolist():
                if (other := union.find(y)) != root:
                    union.up[other] = root
                    links.append((x, y))
    return links


def _links(met: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links between classes, a1, a2, b1 and b2; and, with a null b1, the members that a star did not join to its lead.

    met: place, tiles, s1, s2, side and text, sorted by place and tiles.
    """
    names = ["place", "a1", "a2", "b1", "b2"]

    def settle(place: int, star: bool, s1: list[int], s2: list[int], side: list[int], texts: list[str]) -> list[tuple]:
        sets, of, sides, seen = [], [], [], {}
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < BYTES):
                size += len(texts[end])
                end += 1
            for k, s in enumerate(shingle_sets(texts[at:end], words), at):
                name = s1[k], s2[k]
                if star and name in seen:  # the lead stands in its own tile twice
                    sides[seen[name]] = max(sides[seen[name]], side[k])
                elif (star or (name, side[k]) not in seen) and len(s) and signature(s) == name:
                    seen[name if star else (name, side[k])] = len(sets)
                    sets.append(s)
                    of.append(name)
                    sides.append(side[k])
            at = end
        if len(sets) < 2:
            return []
        links = verified(sets, None if star else np.array(sides), percent)
        found = [(place, *of[i], *of[j]) for i, j in links if of[i] != of[j]]
        if star and 1 in sides:
            joined = Union(len(sets))
            for i, j in links:
                joined.up[joined.find(i)] = joined.find(j)
            lead = joined.find(sides.index(1))
            found += [(place, *of[i], None, None) for i in range(len(sets)) if joined.find(i) != lead]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, held = None, ([], [], [], [])

        def out() -> pa.RecordBatch:
            found = settle(key[0], key[2] < 0, *held) if key is not None else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(5)], names=names)

        for batch in batches:
            for place, a, b, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (place, a, b) != key:
                    yield out()
                    key, held = (place, a, b), ([], [], [], [])
                for column, x in zip(held, rest, strict=True):
                    column.append(x)
        yield out()

    return met.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _classed(docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """Per row of docs: doc_id, n, the signature s1 and s2 of its set, component, and root, which names the class alone."""
    spark = docs.sparkSession
    rows = docs.select(whole_number(docs, key).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = fit_partitions(spark)
    seen = cut(described(rows, words))
    every = seen.where("kind = 0").select("doc_id", "n", *NODE)
    classes = cut(every.where("n > 0").groupBy(*NODE, "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")))
    total = classes.count()
    # Keys name the classes in links as long as each is the least of one class; with null or repeated keys signatures do.
    unique = classes.where("rep is null").isEmpty() and classes.groupBy("rep").count().where("count > 1").isEmpty()
    hot = seen.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("t")).where(F.col("t") >= max(LEAST_HEAVY, HEAVY * total))
    heavy = np.sort(np.array([r["s1"] for r in hot.select("s1").collect()], np.int64).astype(U))  # bounded by the mean set size / HEAVY
    sent = spark.sparkContext.broadcast(heavy)
    of_class = classes.select(
        F.lit(5).alias("kind"), F.shiftrightunsigned(F.shiftrightunsigned("s1", 32) * parts, 32).cast("int").alias("part"),
        F.lit(None).cast("long").alias("doc_id"), "n", *NODE, F.lit(None).cast("binary").alias("payload"),
    )
    counted = _counted(_blocks(rows, sent, parts, words, percent).repartitionById(parts, F.col("part")), parts)
    dealt = counted.unionByName(of_class).repartitionById(parts, F.col("part"))
    places = cut(_places(cut(_prefixes(dealt, percent))))
    wanted = places.select(*NODE).distinct()
    if unique:
        wanted = classes.select(*NODE, F.col("rep").alias("doc_id")).join(_small(wanted), NODE, "left_semi")
        texts = rows.join(_small(cut(wanted)), "doc_id").drop("doc_id")
    else:
        texts = _signed(rows, words, "text", ["n", *NODE]).join(_small(cut(wanted)), NODE, "left_semi").select(*NODE, "text").dropDuplicates(NODE)

    def meet(tiles: DataFrame) -> DataFrame:
        met = tiles.join(texts, NODE).select(*_TILES, *NODE, "side", "text")
        return cut(_links(met.repartition(parts, *_TILES).sortWithinPartitions(*_TILES), words, percent))

    found = meet(_stars(places))
    left = found.where("b1 is null").select("place", F.col("a1").alias("s1"), F.col("a2").alias("s2"))
    if not left.isEmpty():
        found = found.unionByName(meet(_crossings(places, left)))
    links = found.where("b1 is not null")
    if unique:
        rep = lambda x: classes.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("rep").alias(x))
        links = links.join(rep("a"), ["a1", "a2"]).join(rep("b"), ["b1", "b2"])
        node = F.col("rep")
    else:
        named = lambda a, b: F.concat_ws(":", a, b)
        links = links.select(named("a1", "a2").alias("a"), named("b1", "b2").alias("b"))
        node = named("s1", "s2")
    linked = components(links.select("a", "b"))
    known = classes.withColumn("node", node).join(linked, "node", "left").where("k > 1 or component is not null").withColumn("root", F.coalesce("component", "node"))
    if not unique:
        known = known.drop("component").join(known.groupBy("root").agg(F.min("rep").alias("component")), "root")
    known = known.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n").alias("cn"), F.coalesce("component", "rep").alias("component"), "root")
    joined = every.join(known, (every["s1"] == known["c1"]) & (every["s2"] == known["c2"]) & (every["n"] == known["cn"]), "left")
    alone = F.col("doc_id") if unique else F.concat_ws(":", "s1", "s2")
    return joined.select("doc_id", "n", *NODE, F.coalesce("component", "doc_id").alias("component"), F.coalesce("root", alone).alias("root"))


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (the least key that links reach, its own included).

    Two texts link when 100 * (size of the intersection) >= percent * (size of the union) of their sets of distinct word
    n-grams; fewer words than n are one n-gram. Null or empty texts have no n-grams and link with nothing: their component
    is their own key. A row with a null key links as any other, but names no class: one of null keys alone has a null
    component. Rows with one key are told apart by their texts. Keys must be whole numbers. Repeated rows give repeated rows;
    an empty table an empty one; other columns are left out, whatever their names.
    """
    found = _classed(docs, words, percent, key, text)
    return found.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def drop_near(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row for each class: that with the least key. Rows without a key or without words (null and empty texts) all stay.

    Where keys repeat, rows are told apart by their texts, and one of a class's rows of the least key stays. The keys that go
    are broadcast up to SMALL; beyond that the rows of docs meet them in a shuffled join. An empty table gives an empty one; all
    columns stay, whatever their names.
    """
    found = _classed(docs, words, percent, key, text)
    own = F.col(f"`{key}`")
    names = ["n", "s1", "s2", "k", "k1", "k2"]
    n, s1, s2, k, k1, k2 = fresh(docs.columns, *names)
    if docs.where(own.isNotNull()).groupBy(own).count().where("count > 1").isEmpty():
        gone = cut(found.where("doc_id is not null and doc_id <> component").select(F.col("doc_id").alias(k)))
        return docs.join(_small(gone), own == F.col(k), "left_anti")
    stays = found.where("doc_id is not null and n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "s1", "s2")).alias("m"))
    stays = stays.select(F.col("m.doc_id").alias(k), F.col("m.s1").alias(k1), F.col("m.s2").alias(k2))
    signed = _signed(docs, words, text, [n, s1, s2])
    free = own.isNull() | (F.col(n) == 0)
    met = signed.where(~free).join(stays, (own == F.col(k)) & (F.col(s1) == F.col(k1)) & (F.col(s2) == F.col(k2)), "left_semi")
    return signed.where(free).unionByName(met.dropDuplicates([key, s1, s2])).select(*(F.col(f"`{c}`") for c in docs.columns))


def _signed(docs: DataFrame, words: int, text: str, made: list[str]) -> DataFrame:
    """docs with three more columns: the size and signature of each row's set."""
    at = docs.columns.index(text)
    names = [*docs.columns, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, BYTES):
            sets = shingle_sets([x or "" for x in part.column(at).to_pylist()], words)
            both = [signature(s) for s in sets]
            more = ([len(s) for s in sets], [b[0] for b in both], [b[1] for b in both])
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int64()) for x in more)], names=names)

    return map_arrow(docs, run, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in made)]))
