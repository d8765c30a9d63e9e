"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a partition lie in one symbol array. An index maps each pair of adjacent symbols to all its positions;
the active ranks are applied in ascending order, each at all positions of its pair at once, and the lists of the pairs
that a merge makes are extended. Partitions of more than SEGMENT bytes of text are taken in consecutive segments of that size.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import calm, gathered, map_arrow, release, slices, trim, units
from .wordbpe import BITS, MASK, NONE, WordBPE, load, recent

#: Bytes of text over which one index reaches.
SEGMENT = 6 << 20
#: Positions that go to the lists of an index at once.
STRETCH = 1 << 17


class PairIndex:
    """All words in one array of symbols, linked both ways, and the positions of each pair that merges, by rank."""

    def __init__(self, bpe: WordBPE, words: Collection[str]):
        self.keys, self.ranks = bpe.sorted_ranks
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        del raw
        end = np.cumsum(size) - 1
        self.begin = end - size + 1
        self.symbol = np.array(bpe.inner, np.int32)[data]
        self.symbol[end] = np.array(bpe.last, np.int32)[data[end]]
        self.after = np.arange(1, len(data) + 1, dtype=np.int32)
        self.after[end] = -1
        self.before = np.arange(-1, len(data) - 1, dtype=np.int32)
        self.before[self.begin] = -1
        self.where: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        for at in range(0, len(data), STRETCH):
            self._extend(np.flatnonzero(self.after[at : at + STRETCH] >= 0).astype(np.int32) + np.int32(at))

    def _extend(self, left: np.ndarray) -> None:
        """Add the pairs that begin at these positions to the lists of their ranks."""
        if not len(left):
            return
        key = self.symbol[left].astype(np.int64) << BITS | self.symbol[self.after[left]]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        rank, left = self.ranks[at[known]], left[known]
        if len(rank) == 1:
            return self._add(int(rank[0]), left)
        order = np.argsort(rank, kind="stable")
        rank, left = rank[order], left[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, group in zip(rank[np.append(0, cuts)].tolist() if len(rank) else (), np.split(left, cuts), strict=False):
            self._add(r, group)

    def _add(self, rank: int, positions: np.ndarray) -> None:
        if (known := self.where.get(rank)) is None:
            self.where[rank] = known = []
            heapq.heappush(self.active, rank)
        known.append(positions)

    def merge(self, pairs: dict[int, int]) -> None:
        """Apply the active ranks in ascending order. pairs: of each rank and new id, the pair."""
        symbol, after, before = self.symbol, self.after, self.before
        while self.active:
            r = heapq.heappop(self.active)
            a, b, new = pairs[r] >> BITS, pairs[r] & MASK, r & MASK
            lists = self.where.pop(r)
            i = np.unique(np.concatenate(lists))
            j = after[i]
            right = (symbol[i] == a) & (j >= 0)
            right &= symbol[j] == b  # earlier merges took some
            i, j = i[right], j[right]
            if a == b and len(i) > 1:  # of a run of one symbol, every second pair, from the left
                fresh = np.ones(len(i), bool)
                fresh[1:] = j[:-1] != i[1:]
                start = np.flatnonzero(fresh)
                place = np.arange(len(i)) - start[np.cumsum(fresh) - 1]
                i, j = i[place % 2 == 0], j[place % 2 == 0]
            if not len(i):
                continue
            k = after[j]
            symbol[i], symbol[j], after[i] = new, -1, k
            has = k >= 0
            before[k[has]] = i[has]
            left = before[i]
            self._extend(np.concatenate((left[left >= 0], i[has])))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and of each word how many."""
        stay = self.symbol >= 0
        total = np.concatenate(([0], np.cumsum(stay)))
        ends = np.append(self.begin[1:], len(stay))
        return self.symbol[stay], total[ends] - total[self.begin]


def _merged(bpe: WordBPE, words: Collection[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in order, and of each word how many, merged together through one pair occurrence index."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    index = PairIndex(bpe, words)
    index.merge(bpe.pairs)
    return index.ids()


def index_encode(bpe: WordBPE, words: list[str]) -> list[list[int]]:
    """Ids of each word, all words merged together through one pair occurrence index."""
    flat, n = _merged(bpe, words)
    flat, at, found = flat.tolist(), 0, []
    for k in n.tolist():
        found.append(flat[at : at + k])
        at += k
    return found


class Lists:
    """Lists of ids, one after the other in one array."""

    def __init__(self, flat: np.ndarray, n: np.ndarray):
        self.flat, self.n = flat, n
        self.start = np.cumsum(n) - n

    def of(self, which: np.ndarray) -> np.ndarray:
        """The ids of these lists, in this order."""
        n = self.n[which]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.start[which] - end + n, n) + np.arange(end[-1] if len(end) else 0)]


class Codec:
    """Encodes and decodes the texts of a segment.

    What a worker keeps are the numbers of the distinct runs between white spaces, and of each run its ids in one array.
    """

    def __init__(self, bpe: WordBPE, texts: Iterable[list[str]], arrays: bool = False):
        self.tokens, self.decimals, self.arrays = bpe.tokens, bpe.decimals, arrays
        self.runs: dict[str, int] = {}
        for some in texts:
            for x in some:
                self.runs.update(dict.fromkeys(units(x), 0))
        special = {s: -1 - k for k, s in enumerate(bpe.special)}
        words: dict[str, int] = {}
        parts, ends = array("q"), array("q", [0])
        for k, r in enumerate(self.runs):
            self.runs[r] = k
            for is_special, w in bpe.parts(r):
                parts.append(special[w] if is_special else words.setdefault(w, len(words)))
            ends.append(len(parts))
        flat, n = _merged(bpe, words)
        one = np.array(list(bpe.special.values())[::-1], np.int32)  # numbered from the end
        every = Lists(np.append(flat, one), np.append(n, np.ones(len(one), n.dtype)))
        del words
        part = np.frombuffer(parts, np.int64) if parts else np.empty(0, np.int64)
        total = np.append(0, np.cumsum(every.n[part]))
        self.ids = Lists(every.of(part), np.diff(total[np.frombuffer(ends, np.int64)]))

    @staticmethod
    def decode(ids: list[int], tokens: dict[int, str]) -> str:
        """The library's decode for a file without a decoder: the tokens' strings, a space between."""
        return " ".join([tokens[i] for i in ids])

    def text(self, text: str) -> tuple[int, str, str, list[bytes]]:
        """Number of tokens, ids as decimals joined by a space, the decoded text, and the ids' bytes in pieces."""
        found = units(text)
        ids = self.ids.of(np.fromiter(map(self.runs.__getitem__, found), np.int64, len(found)))
        numbers = ids.tolist()
        return len(numbers), self.decode(numbers, self.decimals), self.decode(numbers, self.tokens), [ids.astype("<i4").tobytes()] if self.arrays else []


def _map_coded(docs: DataFrame, path: str, text: str, keep: list[str], schema: str, make) -> DataFrame:
    """docs[keep] and what make(coded texts of a slice) gives, a segment of a partition at a time."""
    types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}
    arrays = "ids" in types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calm()
        release()
        bpe = load(path)
        recent()
        trim()  # of what reading the file and the tables took
        strings = lambda part: [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
        for group in gathered(slices(batches, text), text, SEGMENT):
            codec = Codec(bpe, map(strings, group), arrays)
            for part in group:
                made = make(map(codec.text, strings(part)))
                columns = {k: part.column(part.schema.get_field_index(k)) for k in keep}
                yield pa.RecordBatch.from_pydict(columns | {k: v if isinstance(v, pa.Array) else pa.array(v, types[k]) for k, v in made.items()})
            del codec  # before the next one is made
            trim()

    kept = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    return map_arrow(docs.select(*(F.col(f"`{c}`") for c in [*keep, text])), run, ", ".join([*kept, schema]))


def _lists(n: list[int], raw: list[bytes]) -> pa.Array:
    """The ids of each text, from how many they are and their bytes."""
    flat = np.frombuffer(b"".join(raw), "<i4")
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (array of int) and decoded (string) of each row.

    A null text counts as empty: no ids, ''. Repeated rows give repeated rows; null keys stay; an empty table gives an empty
    one; other columns are left out, whatever their names.
    """

    def make(coded: Iterable[tuple[int, str, str, list[bytes]]]) -> dict[str, list | pa.Array]:
        n, decoded, raw = [], [], []
        for k, _, x, pieces in coded:
            n.append(k)
            decoded.append(x)
            raw += pieces
        return {"ids": _lists(n, raw), "decoded": decoded}

    return _map_coded(docs, path, text, [key], "ids array<int>, decoded string", make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with a column ids) with `decoded`, the library's decode of the ids; null ids give a null, empty ones ''.

    A column named decoded gives way to the new one; other columns and repeated rows stay; an empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def text_of(ids):
        tokens = load(path).tokens
        return ids.map(lambda x: None if x is None else Codec.decode(x, tokens))

    return encoded.withColumn("decoded", text_of("ids"))


def codec_digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each row, after the columns in keep (doc_id); ids: the ids themselves too.

    A null text counts as empty: 0 tokens and the digests of ''. Repeated rows give repeated rows; an empty table gives
    an empty one; columns of docs not in keep are left out. Needs no shuffle.
    """

    digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def make(coded: Iterable[tuple[int, str, str, list[bytes]]]) -> dict[str, list | pa.Array]:
        n, of_ids, of_text, raw = [], [], [], []
        for k, numbers, x, pieces in coded:
            n.append(k)
            of_ids.append(digest(numbers))
            of_text.append(digest(x))
            raw += pieces
        return {"n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text} | ({"ids": _lists(n, raw)} if ids else {})

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _map_coded(docs, path, text, keep or ["doc_id"], f"{schema}, ids array<int>" if ids else schema, make)
