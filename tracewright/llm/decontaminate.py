"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the windows of every text.

Words are what WORD finds after A-Z are lower-cased. A window is `size` consecutive words of an item; an item of fewer,
but not none, is one window of all its words. The set is broadcast whole while the windows of the benchmark are at most
MOST_WINDOWS and its texts at most MOST_BYTES. A larger benchmark is dealt into blocks below these bounds; each is broadcast in
its turn and scanned for, and the hits of all blocks come together for each text. No window is ever a key of a shuffle, so
however often one occurs, no task gets all its occurrences.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh, map_arrow, map_texts, release, slices, union

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_WINDOWS, MOST_BYTES = 2_000_000, 64 << 20
#: Words after which a long item is cut into pieces that overlap by all but one word of a window.
PIECE = 4_096
_words = re.compile(WORD)


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.encode().lower().decode()


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _windows(words: list[str], size: int) -> list[tuple[str, ...]]:
    n = len(words)
    return [tuple(words[i : i + size]) for i in range(n - size + 1)] if n >= size else [tuple(words)] if n else []


class Scanner:
    """Finds the windows of a benchmark in texts. items: (id, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.word: dict[str, int] = {}
        self.sets: dict[int, dict[int, list[tuple[bytes, set[str]]]]] = defaultdict(dict)  # window length -> digest -> windows and their items
        for item, text in items:
            for w in _windows(_words.findall(lowered(text or "")), size):
                ids = np.array([self.word.setdefault(x, len(self.word)) for x in w], np.int64)
                same = self.sets[len(w)].setdefault(int(self._digests_at(ids, np.zeros(1, np.int64), len(w))[0]), [])
                found = next((s for k, s in same if k == ids.tobytes()), None)
                if found is None:
                    same.append((ids.tobytes(), found := set()))
                found.add(item or "")
        self.digests = {n: np.sort(np.fromiter(d, np.uint64, len(d))) for n, d in self.sets.items()}

    @staticmethod
    def _digests_at(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Of the run of n ids that begins at each of these places."""
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = (h ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def scan(self, texts: list[list[str]]) -> list[tuple[int, set[str], np.ndarray]]:
        """Of each list of words: how many are hit, the items, and the positions that are hit."""
        get = self.word.get
        ids, start = [], []
        for ws in texts:
            start.append(len(ids))
            ids += [get(w, -1) for w in ws]
            ids.append(-1)  # no window reaches over the end of a text
        ids = np.array(ids, np.int64)
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        hit, items = np.zeros(len(ids) + 1, np.int64), defaultdict(set)
        for n, digests in self.digests.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            of = self._digests_at(ids, at, n)
            where = np.searchsorted(digests, of)
            fits = (where < len(digests)) & (digests[np.minimum(where, len(digests) - 1)] == of)
            for i, digest in zip(at[fits].tolist(), of[fits].tolist(), strict=True):
                raw = ids[i : i + n]
                for key, names in self.sets[n][digest]:
                    if key == raw.tobytes():  # verified
                        hit[i] += 1
                        hit[i + n] -= 1
                        items[int(np.searchsorted(start, i, "right")) - 1] |= names
        inside = np.cumsum(hit)[:-1] > 0
        found = []
        for k, ws in enumerate(texts):
            where = np.flatnonzero(inside[start[k] : start[k] + len(ws)]) if k in items else np.empty(0, np.int64)
            found.append((len(where), items.get(k, set()), where))
        return found


def _pieces(benchmark: DataFrame, size: int, item: str, text: str, piece: int = PIECE) -> DataFrame:
    """item, w (consecutive words), n (their windows): each item with a window, long ones in pieces that share no window.

    Equal rows are one row before anything is counted.
    """
    words = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), words_of(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))  # where the last window starts, from 0
    cuts = words.distinct().select("item", "w", F.explode(F.sequence(F.lit(0), F.floor(last / piece).cast("int"))).alias("k"))
    part = cuts.select("item", F.slice("w", F.col("k") * piece + 1, F.lit(piece + size - 1)).alias("w"))
    return part.withColumn("n", F.greatest(F.size("w") - (size - 1), F.lit(1))).select("item", F.concat_ws(" ", "w").alias("w"), "n").distinct()


def _packed(pieces: DataFrame, blocks: int, most: int) -> DataFrame:
    """pieces with part and block: each task fills blocks one after the other, up to `most` windows and MOST_BYTES of text; a
    piece, which has `most` windows at most, is never split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = windows = held = 0
        for batch in batches:
            found = []
            for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size = len(w.encode("utf-8", "surrogatepass"))
                if windows and (windows + n > most or held + size > MOST_BYTES):
                    block, windows, held = block + 1, 0, 0
                windows, held = windows + n, held + size
                found.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=["item", "w", "n", "block"])

    dealt = pieces.repartition(blocks, F.xxhash64("item", "w")).mapInArrow(run, "item string, w string, n int, block int")
    return cut(dealt.withColumn("part", F.spark_partition_id()))


def _blocks(benchmark: DataFrame, size: int, item: str, text: str, most: int) -> Iterator[Callable[[], Scanner]]:
    """Makers of scanners on workers, by broadcast: of the whole benchmark where it is within the bounds, else of block after block."""
    pieces = cut(_pieces(benchmark, size, item, text, max(1, min(PIECE, most))))
    context = benchmark.sparkSession.sparkContext
    windows, held = pieces.agg(F.sum("n"), F.sum(F.octet_length("w"))).first()
    blocks = max(1, -(-(windows or 0) // most), -(-(held or 0) // MOST_BYTES))
    if blocks == 1:
        yield _maker(context.broadcast([(r["item"], r["w"]) for r in pieces.collect()]), size)  # within the bounds
        return
    packed = _packed(pieces, blocks, most)
    for k in sorted(tuple(r) for r in packed.select("part", "block").distinct().collect()):  # about as many as blocks
        own = packed.where((F.col("part") == k[0]) & (F.col("block") == k[1]))
        yield _maker(context.broadcast([(r["item"], r["w"]) for r in own.collect()]), size)  # a block, within the bounds


def _maker(sent, size: int) -> Callable[[], Scanner]:
    made: list[Scanner] = []

    def make() -> Scanner:
        if not made:
            made.append(Scanner(sent.value, size))
        return made[0]

    return make


def _digests(split: list[list[str]], got: list[tuple[int, set[str]]]) -> dict[str, list]:
    return {
        "n_words": [len(s) for s in split],
        "n_hit": [g[0] for g in got],
        "n_items": [len(g[1]) for g in got],
        "items_sha256": [hashlib.sha256(",".join(sorted(g[1])).encode()).hexdigest() for g in got],
        "contaminated": [g[0] > 0 for g in got],
    }


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", most: int = MOST_WINDOWS) -> DataFrame:
    """Per row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated.

    items_sha256 is of the item ids, sorted as strings and joined by commas ('' if none); a null id counts as ''. Null or
    empty texts have no words; null items no windows. Repeated rows give repeated rows, repeated items count once. An empty
    table gives an empty one, an empty benchmark no hits. Other columns are left out, whatever their names. most: windows of
    a block, which changes no result.
    """
    makers = list(_blocks(benchmark, size, item, text, most))
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    schema = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    if len(makers) == 1:

        def work_of() -> Callable[[list[str]], dict[str, list]]:
            scanner = makers[0]()

            def work(texts: list[str]) -> dict[str, list]:
                split = [_words.findall(lowered(x)) for x in texts]
                return _digests(split, [g[:2] for g in scanner.scan(split)])

            return work

        return map_texts(rows, work_of, [key], schema, text)
    (hits,) = fresh([key, text], "hits")
    marked = _with_hits(rows, makers, text, hits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            split = [_words.findall(lowered(x or "")) for x in part.column(1).to_pylist()]
            found = [(len(_positions(h)), set().union(*(b["items"] for b in h or ()))) for h in part.column(2).to_pylist()]
            made = _digests(split, found)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(made.values(), types, strict=True))], names=[key, *made])

    return map_arrow(marked, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}")


def _positions(hits: list | None) -> list[int]:
    """The places of hit words, in order, from what the blocks found."""
    return sorted({p for b in hits or () for first, n in b["spans"] for p in range(first, first + n)})


_HIT = "hash string, items array<string>, spans array<array<int>>"


def _with_hits(docs: DataFrame, makers: list[Callable[[], Scanner]], text: str, name: str) -> DataFrame:
    """docs with one more column: what each block of the benchmark hits in the text (null: nothing).

    Each block is scanned for in a pass of its own, so that one block at a time is in a worker's memory. Hits are keyed by the
    text's digest: copies share them.
    """
    found = []
    for make in makers:

        def run(batches: Iterator[pa.RecordBatch], make=make) -> Iterator[pa.RecordBatch]:
            scanner = make()
            for part in slices(batches, "text"):
                texts = [x or "" for x in part.column(0).to_pylist()]
                rows = [(x, g) for x, g in zip(texts, scanner.scan([_words.findall(lowered(x)) for x in texts]), strict=True) if g[0]]
                spans = [[[int(r[0]), len(r)] for r in np.split(g[2], np.flatnonzero(np.diff(g[2]) > 1) + 1)] for _, g in rows]
                columns = ([hashlib.sha256(x.encode()).hexdigest() for x, _ in rows], [sorted(g[1]) for _, g in rows], spans)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))), strict=True)], names=["hash", "items", "spans"])

        found.append(cut(docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, _HIT).dropDuplicates(["hash"])))
    digest, of = fresh([*docs.columns, name], "digest", "hash")
    every = union(found).groupBy(F.col("hash").alias(of)).agg(F.collect_list(F.struct("items", "spans")).alias(name))  # a row a block
    signed = docs.withColumn(digest, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    return signed.join(every, F.col(digest) == F.col(of), "left").drop(digest, of)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = 10, text: str = "text", item: str = "item_id", most: int = MOST_WINDOWS) -> DataFrame:
    """docs without what the benchmark shares with them, all columns kept, whatever their names.

    remove='documents' drops each row with a hit; remove='spans' keeps the row and takes out of its text each stretch from
    the first to the last character of consecutive hit words. Null texts stay null. Rows without hits stay as they are, as do
    all with an empty benchmark. Repeated rows share their fate; an empty table gives an empty one. most: windows of a block,
    which changes no result.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be documents or spans")
    makers = list(_blocks(benchmark, size, item, text if text in benchmark.columns else "text", most))
    names = docs.columns
    i = names.index(text)
    (hits,) = fresh(names, "hits")
    rows = docs if len(makers) == 1 else _with_hits(docs, makers, text, hits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scanner = makers[0]() if len(makers) == 1 else None
        for part in slices(batches, text):
            texts = part.column(i).to_pylist()
            if scanner:
                found = [g[2].tolist() for g in scanner.scan([_words.findall(lowered(x or "")) for x in texts])]
            else:
                found, part = [_positions(h) for h in part.column(len(names)).to_pylist()], part.select(names)
            if remove == "documents":
                yield part.filter(pa.array([not f for f in found], pa.bool_()))
                continue
            clean = [without(x, f) if f else x for x, f in zip(texts, found, strict=True)]
            yield part.set_column(i, part.schema.field(i), pa.array(clean, part.schema.field(i).type))

    return map_arrow(rows, run, docs.schema)


def without(text: str, hit: list[int]) -> str:
    """text less each stretch of consecutive hit words; lower-casing A-Z moves no position."""
    spans = [m.span() for m in _words.finditer(lowered(text))]
    kept, at, k = [], 0, 0
    while k < len(hit):
        first = k
        while k + 1 < len(hit) and hit[k + 1] == hit[k] + 1:
            k += 1
        kept.append(text[at : spans[hit[first]][0]])
        at = spans[hit[k]][1]
        k += 1
    return "".join([*kept, text[at:]])
