"""Line deduplication over ranges of hashes, with bitmaps as results.

The distinct keys of each document, as 128-bit hashes, are dealt by ranges of (hash, document) and sorted by hash, then by
document from the largest, with their positions. Each task streams its range: the first document of a key is the one
that keeps its lines, the others lose theirs once enough documents are known to hold the key. A key that reaches over
a border between tasks (two a task at most) is left open there and settled from the sums over the tasks, so one
very common line spreads over as many tasks as its rows need. What comes back is a compressed bitmap of kept lines for each
document that loses any; texts never shuffle with the keys.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fit_partitions, fresh, whole_number

LEAST_CHARS, LEAST_DOCS = 20, 3
BLANK = " \t\n\x0b\x0c\r"
#: Bytes up to which all bitmaps together are broadcast.
SMALL_BITMAPS = 32 << 20


def line_keys(text: Column, least: int = LEAST_CHARS) -> Column:
    """Of each line of text in order: its key, or null where the key is too short to count."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    stripped = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANK)))
    return F.transform(stripped, lambda x: F.when(F.char_length(x) >= least, x))


def occurrences(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """h1, h2, doc, text_hash, at (positions): one row for each key of each row of docs (doc_id, text, text_hash)."""
    keyed = docs.select("doc_id", "text_hash", F.posexplode(line_keys(F.col("text"), least)).alias("at", "key")).where("key is not null")
    hashed = keyed.select("doc_id", "text_hash", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key", F.lit("2")).alias("h2"))
    return hashed.select("h1", "h2", "doc_id", "text_hash", "at")


#: What a streamed row says: the line goes; it is left open; its document is a witness to the key.
GONE, OPEN, WITNESS = 0, 1, 2
_ROW = "kind int, h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, at int"
_NO_ID = -(1 << 62)


class _Stream:
    """Over rows sorted by hash, document (descending), text_hash and position: the positions that go, and those left open.

    What is carried from batch to batch is the last key, its first document, how many documents it has, and the rows of its
    first few documents while they are too few to judge. Rows of the task's first key go out as open at once: an earlier task
    may hold its first document. Of the first and last keys, the first few documents go out as witnesses, from which the
    number of documents and the first one are known over all tasks.
    """

    def __init__(self, least_docs: int):
        self.least = least_docs
        self.key: tuple[int, int] | None = None
        self.is_first = True
        self.docs, self.first_doc, self.last_doc = 0, 0, 0
        self.held: list[pa.RecordBatch] = []
        self.seen: list[pa.RecordBatch] = []  # the key's witnesses

    def _rows(self, kind: int, part: pa.RecordBatch, pick: np.ndarray) -> pa.RecordBatch:
        taken = part.take(pa.array(np.flatnonzero(pick)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(taken.num_rows, kind, np.int32)), *taken.columns], names=["kind", *part.schema.names])

    def take(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = part.num_rows
        h1, h2 = part.column(0).to_numpy(), part.column(1).to_numpy()
        doc = part.column(2).fill_null(_NO_ID).to_numpy()
        goes_on = self.key == (int(h1[0]), int(h2[0]))
        new_key = np.ones(n, bool)
        new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        key = np.cumsum(new_key) - 1
        start = np.flatnonzero(new_key)
        new_doc = new_key.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        new_doc[0] = not goes_on or doc[0] != self.last_doc
        number = np.cumsum(new_doc)
        number -= (number[start] - new_doc[start])[key]  # of the row's document among its key's
        if goes_on:
            number[key == 0] += self.docs
        total = number[np.append(start[1:], n) - 1]
        later = number > 1
        last, first = key == key[-1], (key == 0) & (self.is_first if goes_on else self.key is None)
        witness = new_doc & (number <= self.least) & (first | last)
        enough = (total >= self.least)[key]
        if goes_on and enough[0] and self.held:
            yield from self._release(GONE)
        yield self._rows(GONE, part, later & enough & ~first)
        yield self._rows(OPEN, part, first)
        yield self._rows(WITNESS, part, witness & first)
        if key[-1] > 0 or not goes_on:
            self.is_first = self.key is None and key[-1] == 0
            self.held, self.seen = [], []
        if not self.is_first:
            self.seen.append(self._rows(WITNESS, part, witness & last & ~first))
            self.held.append(self._rows(OPEN, part, later & ~enough & last & ~first))
        self.key, self.docs, self.last_doc = (int(h1[-1]), int(h2[-1])), int(total[-1]), doc[-1]

    def _release(self, kind: int) -> Iterator[pa.RecordBatch]:
        for rows in self.held:
            yield rows.set_column(0, "kind", pa.array(np.full(rows.num_rows, kind, np.int32)))
        self.held = []

    def finish(self) -> Iterator[pa.RecordBatch]:
        """The task is over: the last key may go on in the next one."""
        yield from self.held
        yield from self.seen


def _streamed(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(least_docs)
        for batch in batches:
            if batch.num_rows:
                yield from (x for x in stream.take(batch) if x.num_rows)
        yield from (x for x in stream.finish() if x.num_rows)

    return run


def dropped(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text_hash, at: the lines that go."""
    # kept once: the sample for the ranges and the sort itself read hashes, not texts
    rows = cut(occurrences(docs, least))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("text_hash"), F.col("at")]
    dealt = rows.repartitionByRange(fit_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    streamed = cut(dealt.mapInArrow(_streamed(least_docs), _ROW))
    # two keys a task at most, and of each least_docs documents; one that reaches over a border counts once
    id_of = F.coalesce("doc_id", F.lit(_NO_ID))
    sums = streamed.where(F.col("kind") == WITNESS).groupBy("h1", "h2").agg(F.countDistinct(id_of).alias("n"), F.max(id_of).alias("last")).where(F.col("n") >= least_docs)
    late = streamed.where(F.col("kind") == OPEN).join(F.broadcast(sums), ["h1", "h2"]).where(id_of != F.col("last"))
    return streamed.where(F.col("kind") == GONE).unionByName(late.select(streamed.columns)).select("doc_id", "text_hash", "at")


def pack(kept: np.ndarray) -> bytes:
    """A bitmap of kept lines, compressed: its length and zlib of the packed bits."""
    return len(kept).to_bytes(4, "little") + zlib.compress(np.packbits(kept).tobytes(), 1)


def unpack(bitmap: bytes) -> np.ndarray:
    n = int.from_bytes(bitmap[:4], "little")
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap[4:]), np.uint8))[:n].astype(bool)


def keep_bitmaps(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, bitmap: for each document that loses lines, which of its lines stay.

    Bits past the last line that goes are not stored: they all stay. text_hash tells rows apart that share a doc_id; equal
    rows share one bitmap. Null and empty texts lose nothing; an empty table gives an empty one.
    """
    rows = docs.select(whole_number(docs, key).alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))

    @F.pandas_udf("binary")
    def bitmap(gone):
        def one(at):
            kept = np.ones(max(at) + 1, bool)
            kept[np.asarray(at)] = False
            return pack(kept)

        return gone.map(one)

    return dropped(rows, least, least_docs).groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("at")).select("doc_id", "text_hash", bitmap("at").alias("bitmap"))


def with_bitmaps(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, key: str = "doc_id", text: str = "text", name: str = "_bitmap") -> DataFrame:
    """docs with one more column of this name, null where all lines stay.

    The bitmaps are broadcast only while all of them are at most SMALL_BITMAPS bytes, so that no text shuffles; beyond that
    they meet the texts in a shuffled join. Null keys and texts, repeated rows and an empty table are as in line_dedup;
    a column of that name is an error, other columns may have any names.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {name}")
    an_id, a_hash = fresh([*docs.columns, name], "id", "hash")
    maps = cut(keep_bitmaps(docs, least, least_docs, key, text)).select(F.col("doc_id").alias(an_id), F.col("text_hash").alias(a_hash), F.col("bitmap").alias(name))
    size = maps.agg(F.sum(F.octet_length(name) + 32)).first()[0] or 0
    same = whole_number(docs, key).eqNullSafe(F.col(an_id)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(a_hash))
    return docs.join(F.broadcast(maps) if size <= SMALL_BITMAPS else maps, same, "left").drop(an_id, a_hash)


def apply(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines, lines that go, and what stays."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return len(lines), 0, text or ""
    kept = unpack(bitmap)
    stay = [x for i, x in enumerate(lines) if i >= len(kept) or kept[i]]
    return len(lines), len(lines) - len(stay), "\n".join(stay)


def line_dedup(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_lines, n_dropped, kept_sha256.

    A key that at least `least_docs` documents hold loses its lines everywhere but in the document with the largest key
    column, which keeps all of them. Null and empty texts are one empty line. A null doc_id is a document smaller than all
    others; rows with one doc_id are one document, and each is judged by its own lines. Keys must be whole numbers. Repeated
    rows give repeated rows; an empty table an empty one; other columns are left out, whatever their names.
    """
    rows = with_bitmaps(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), least, least_docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [apply(x, b) for x, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2].encode()).hexdigest() for g in got])],
                names=[key, "n_lines", "n_dropped", "kept_sha256"],
            )

    return rows.select(key, text, "_bitmap").mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_lines bigint, n_dropped bigint, kept_sha256 string")
