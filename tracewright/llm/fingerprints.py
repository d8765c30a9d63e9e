"""Document fingerprints by a homomorphic multiset hash.

A paragraph (a line of text) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors, each place modulo
a power of two. The order of paragraphs doesn't matter, a paragraph is inserted or deleted by adding or subtracting its vector, and sums
of fingerprints are fingerprints of the paragraphs of several documents together.

A vector has two parts. SUMS places modulo 2**64 come from a digest of the whole paragraph: with them, equal multisets of
paragraphs have equal fingerprints and others differ. LANES places modulo 2**24 hold the paragraph's distinct shingles of
WORDS words (all its words, if fewer), each as +1 or -1 in one place: a linear sketch, from whose differences the likeness of
two documents is estimated, 2 * (shingles in common) / (shingles of both), with a standard error of about 1 / sqrt(LANES).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from .common import Memo, calm, fit_partitions, map_texts, slices, whole_number

SUMS, LANES, LANE_BITS, WORDS = 4, 192, 24, 3
MOST_WORDS = 200_000
_LANE = (1 << LANE_BITS) - 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _codes() -> Memo:
    """Of words; one per worker process."""
    return Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), MOST_WORDS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _shingles(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph number and hash of each distinct shingle of each paragraph."""
    split = [p.split() for p in paragraphs]
    n = np.fromiter(map(len, split), np.int64, len(split))
    memo = _codes()
    code = np.fromiter((memo[w] for s in split for w in s), np.uint64, int(n.sum()))
    of = np.repeat(np.arange(len(split)), n)
    found = []
    gram = code
    for k in range(1, WORDS + 1):
        if k > 1:
            gram = _mixed(gram[: len(code) - k + 1]) * _FACTOR + code[k - 1 :]
        whole = of[: len(gram)] == of[k - 1 :]
        whole &= (n[of[: len(gram)]] == k) if k < WORDS else True
        found.append((of[: len(gram)][whole], _mixed(gram[whole] + np.uint64(k))))
        if len(code) <= k:
            break
    at, h = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    by = np.lexsort((h, at))
    at, h = at[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return at[new], h[new]


class Sums:
    """Fingerprints as arrays: whole (uint64, SUMS wide) and lanes (LANES wide, modulo 2**LANE_BITS)."""

    def __init__(self, whole: np.ndarray, lanes: np.ndarray):
        self.whole, self.lanes = whole, lanes & _LANE

    def __len__(self) -> int:
        return len(self.whole)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.whole + other.whole, self.lanes + other.lanes)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.whole - other.whole, self.lanes - other.lanes)

    def __getitem__(self, at) -> Sums:
        return Sums(self.whole[at], self.lanes[at])

    def texts(self) -> list[str]:
        raw = self.lanes.astype("<u4").view(np.uint8).reshape(len(self), LANES, 4)[:, :, : LANE_BITS // 8]
        return [base64.b64encode(w.tobytes() + x.tobytes()).decode() for w, x in zip(self.whole.astype("<u8"), raw, strict=True)]


def joined(*parts: Sums) -> Sums:
    return Sums(np.concatenate([p.whole for p in parts]), np.concatenate([p.lanes for p in parts]))


def read(texts: list[str]) -> Sums:
    """The inverse of Sums.texts."""
    raw = np.frombuffer(b"".join(map(base64.b64decode, texts)), np.uint8).reshape(len(texts), SUMS * 8 + LANES * LANE_BITS // 8)
    lanes = np.zeros((len(texts), LANES, 4), np.uint8)
    lanes[:, :, : LANE_BITS // 8] = raw[:, SUMS * 8 :].reshape(len(texts), LANES, LANE_BITS // 8)
    return Sums(raw[:, : SUMS * 8].copy().view("<u8").astype(np.uint64), lanes.reshape(len(texts), -1).view("<u4").astype(np.int64))


def sums(groups: list[list[str]]) -> Sums:
    """The sum of the vectors of each group of paragraphs."""
    paragraphs = [p for g in groups for p in g]
    n = np.fromiter(map(len, groups), np.int64, len(groups))
    digests = np.frombuffer(b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=8 * SUMS).digest() for p in paragraphs), "<u8").astype(np.uint64).reshape(-1, SUMS)
    up_to = np.concatenate((np.zeros((1, SUMS), np.uint64), np.cumsum(digests, axis=0, dtype=np.uint64)))  # modulo 2**64
    ends = np.cumsum(n)
    whole = up_to[ends] - up_to[ends - n]
    at, h = _shingles(paragraphs) if paragraphs else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    place = np.repeat(np.arange(len(groups)), n)[at] * LANES + ((h >> np.uint64(1)) % np.uint64(LANES)).astype(np.int64)
    lanes = np.bincount(place, np.where(h & np.uint64(1), 1.0, -1.0), minlength=len(groups) * LANES)
    return Sums(whole, lanes.astype(np.int64).reshape(len(groups), LANES))


def likeness(a: Sums, b: Sums) -> np.ndarray:
    """Between 0 and 1, row by row; 1 for equal fingerprints. Without any word on either side, 0 unless they are equal."""
    signed = lambda x: ((x + (_LANE + 1) // 2) & _LANE) - (_LANE + 1) // 2
    square = lambda x: (signed(x).astype(np.float64) ** 2).sum(axis=1)
    apart, both = square(a.lanes - b.lanes), square(a.lanes) + square(b.lanes)
    equal = (a.whole == b.whole).all(axis=1)
    return np.where(both > 0, np.clip(1 - apart / np.maximum(both, 1), 0, 1), equal.astype(np.float64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every row. A null text is an empty one, which has one empty paragraph."""
    return map_texts(docs, lambda: lambda texts: {"fingerprint": sums([x.split("\n") for x in texts]).texts()}, [key], "fingerprint string", text)


@F.pandas_udf(StringType())
def inserted(fingerprint, paragraphs):
    """The fingerprint after paragraphs (an array of texts; null: none) are added; deleted() takes them out."""
    return type(fingerprint)((read(fingerprint.tolist()) + sums([list(p) if p is not None else [] for p in paragraphs])).texts())


@F.pandas_udf(StringType())
def deleted(fingerprint, paragraphs):
    return type(fingerprint)((read(fingerprint.tolist()) - sums([list(p) if p is not None else [] for p in paragraphs])).texts())


def total(found: DataFrame, column: str = "fingerprint") -> str:
    """The fingerprint of all paragraphs of all rows together; the driver sees one row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sums([[]])
        for batch in batches:
            if batch.num_rows:
                got = read(batch.column(0).to_pylist())
                held += Sums(got.whole.sum(axis=0, dtype=np.uint64)[None], got.lanes.sum(axis=0)[None])
        yield pa.RecordBatch.from_pydict({column: held.texts()})

    held = sums([[]])
    for r in found.select(column).where(F.col(column).isNotNull()).mapInArrow(run, f"{column} string").collect():
        held += read([r[0]])
    return held.texts()[0]


def _keys(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(key, hash) as bytes in the same order."""
    flip = np.uint64(1 << 63)
    both = np.stack([x.astype(np.int64).view(np.uint64) ^ flip for x in (key, h)], axis=1).astype(">u8")
    return both.view("S16").ravel()


_NO_KEY = -(1 << 63)


def _beginnings(rows: DataFrame) -> np.ndarray:
    """The first (key, hash) of each of about as many equal ranges of rows as there are shuffle partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    by = ["k", "h"]
    ids = rows.select(F.coalesce("k", F.lit(_NO_KEY)).alias("k"), "h").repartitionByRange(fit_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    found = ids.mapInArrow(run, "k bigint, h bigint").collect()  # one row a partition
    return np.sort(_keys(np.array([r["k"] for r in found], np.int64), np.array([r["h"] for r in found], np.int64)))


def halves(text: str) -> tuple[str, int]:
    """What stays of a text when its last half goes, and how many code points go."""
    return text[: len(text) - len(text) // 2], len(text) // 2


class _Slice:
    """Some consecutive documents: their fingerprints, and what goes with their last halves."""

    def __init__(self, texts: list[str]):
        self.texts, self.heads = texts, [halves(x) for x in texts]
        lines = [x.split("\n") for x in texts]
        kept = [head.count("\n") for head, _ in self.heads]
        got = sums([part for own, k in zip(lines, kept, strict=True) for part in (own[:k], own[k:])])
        self.gone = got[1::2]
        self.whole = got[::2] + self.gone


def next_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next document's
    (all, if it has fewer), in order of keys; after the last comes the first. Its fingerprint comes from the text's: the
    paragraphs from the cut on are subtracted, those that take their place are added. near_edited and near_next are the
    likeness of the text to the edited text and to the next document.

    A null text is an empty one. A null key comes before all others; rows with one key follow each other by a hash of their
    texts; repeated rows stay rows. Keys must be whole numbers. An empty table gives an empty one; other columns are left
    out, whatever their names.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(whole_number(docs, key).alias("k"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    begins = _beginnings(rows)
    if not len(begins):
        return docs.sparkSession.createDataFrame([], schema)
    sent = docs.sparkSession.sparkContext.broadcast(begins)  # a key a partition

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's range, and the first row of each range once more, at the end of the range before."""
        for batch in batches:
            own = _keys(batch.column(0).fill_null(_NO_KEY).to_numpy(), batch.column(1).to_numpy())
            part = np.searchsorted(sent.value, own, "right") - 1
            first = np.flatnonzero(sent.value[part] == own)
            for rows, where, edge in ((batch, part, 0), (batch.take(pa.array(first)), (part[first] - 1) % len(sent.value), 1)):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(where.astype(np.int32)), pa.array(np.full(len(where), edge, np.int32))], names=["k", "h", "text", "part", "edge"])

    dealt = rows.mapInArrow(deal, "k bigint, h bigint, text string, part int, edge int").repartitionById(len(begins), F.col("part"))
    order = ["part", "edge", F.col("k").asc_nulls_first(), "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calm()
        ids, held = [], None  # of the last document so far, which waits for its next one
        over = False
        for batch in slices(batches, "text"):
            if over:
                continue
            edges = np.flatnonzero(batch.column(4).to_numpy())
            if len(edges):  # all copies of the next range's first row are alike
                batch, over = batch.slice(0, int(edges[0]) + 1), True
            now = _Slice(batch.column(2).to_pylist())
            keys = batch.column(0).to_pylist()
            texts, heads, whole, gone = now.texts, now.heads, now.whole, now.gone
            if held:
                texts, heads, whole, gone = [held[0], *texts], [held[1], *heads], joined(held[2], whole), joined(held[3], gone)
            ids += keys
            edited = [head + after[:n] for (head, n), after in zip(heads, texts[1:], strict=False)]
            new = sums([e[head.rfind("\n") + 1 :].split("\n") for (head, _), e in zip(heads, edited, strict=False)])
            last = len(edited)
            own = whole[:last]
            other = own - gone[:last] + new
            if last:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[:last], pa.int64()).cast(key_type), pa.array([len(x) for x in texts[:last]], pa.int64()), pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                        pa.array(own.texts()), pa.array(other.texts()), pa.array(likeness(own, other)), pa.array(likeness(own, whole[1:])),
                    ],
                    names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
            ids, held = ids[last:], (texts[-1], heads[-1], whole[-1:], gone[-1:])

    key_type = to_arrow_type(docs.schema[key].dataType)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, schema)
