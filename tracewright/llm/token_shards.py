"""Token ids in sorted-string-table shards.

A shard holds the documents of one range of identifiers in ascending order: data blocks of prefix-compressed entries, a
sparse index with the first key and place of each block, a Bloom filter over the keys, and a fixed footer. A document is
found by binary search in the index of its shard and a scan of one block.

Layout, all integers little-endian: blocks | index | filter | footer. A block is zstd-compressed entries: shared prefix
length u8, rest length u8, rest of key, value length u32, value (ids of `width` bytes). An index entry: key length u8, key,
offset u64, length u32. Footer: index offset u64, index length u64, filter offset u64, filter length u64, documents u64,
ids u64, width u8, magic 8 bytes. A key is 8 bytes, big-endian with the sign bit turned, so that bytes sort as integers do;
a null identifier has the empty key and comes first.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Recent, calm, fit_partitions, input_bytes, slices, whole_number

MAGIC = b"TOKSST01"
FOOTER = struct.Struct("<QQQQQQB8s")
BLOCK_BYTES = 1 << 18
BITS_PER_KEY, PROBES = 10, 7
MOST_PIECES = 900_000
#: Bytes of input for a shard.
SHARD_BYTES = 256 << 20
#: Marks that a piece may end with.
MARKS = string.punctuation


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(key: bytes, bits: int) -> Iterator[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return ((a + i * b) % bits for i in range(PROBES))


class Writer:
    """Writes one shard; keys come in ascending order, equal ones allowed."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.entries, self.size, self.first, self.last = [], 0, b"", b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.ids = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if not self.entries:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.entries += [bytes((shared, len(key) - shared)), key[shared:], struct.pack("<I", len(value)), value]
        self.last, self.size = key, self.size + len(value) + 16
        self.keys.append(key)
        self.ids += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            at = self.at
            n = self._put(self.pack.compress(b"".join(self.entries)))
            self.index.append(bytes((len(self.first),)) + self.first + struct.pack("<QI", at, n))
            self.entries, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index_at, index_n = self.at, self._put(b"".join(self.index))
        bits = max(8, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at, bloom_n = self.at, self._put(bytes(bloom))
        self._put(FOOTER.pack(index_at, index_n, bloom_at, bloom_n, len(self.keys), self.ids, self.width, MAGIC))


class Reader:
    """Reads one shard: all of it in order, or one document by its identifier."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        self.index_at, n, self.bloom_at, bloom_n, self.docs, self.ids, self.width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.bloom_n, self.index, raw, i = bloom_n, [], self._at(self.index_at, n), 0
        while i < n:
            k = raw[i]
            self.index.append((raw[i + 1 : i + 1 + k], *struct.unpack_from("<QI", raw, i + 1 + k)))
            i += 13 + k

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        raw, i, last = zstandard.ZstdDecompressor().decompress(self._at(*self.index[k][1:])), 0, b""
        while i < len(raw):
            last = last[: raw[i]] + raw[i + 2 : i + 2 + raw[i + 1]]
            i += 2 + raw[i + 1]
            (n,) = struct.unpack_from("<I", raw, i)
            yield last, raw[i + 4 : i + 4 + n]
            i += 4 + n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document with this identifier, or None."""
        key = key_of(doc_id)
        bloom = self._at(self.bloom_at, self.bloom_n)
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(bloom) * 8)):
            return None
        low, high = 0, len(self.index)
        while low < high:  # the first block whose first key is not below ours
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        for k in range(max(0, low - 1), min(low + 1, len(self.index))):
            for found, value in self._block(k):
                if found == key:
                    return np.frombuffer(value, f"<u{self.width}")
        return None


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Pieces:
    """Ids of whole texts by the library, through a memo of the pieces between single spaces.

    Splitting before a space never changes the ids where the space follows a non-space, or a space precedes a non-space;
    texts with longer runs of white space go to the library as they are.
    """

    #: A space after one of these may belong to a longer run.
    WHITE = [chr(c) + " " for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.kind = "H" if width == 2 else "I"
        self.first, self.later = Recent(MOST_PIECES // 8), Recent(MOST_PIECES)
        self.longer = regex.compile(r"[\p{White_Space}\x1c-\x1f] (?!\P{White_Space})").search

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def odd(self, text: str) -> bool:
        return any(w in text for w in self.WHITE) and bool(self.longer(text)) or text.endswith(" ")

    def _learn(self, memo: Recent, new: set[str], before: str) -> dict[str, bytes]:
        """Ids of new pieces. The marks after a last letter or digit never join it, so they are encoded by themselves."""
        made, parts, cores, tails = {}, [], {}, {}
        for p in new:
            core = p.rstrip(MARKS)
            if len(core) < len(p) and core and core[-1].isalnum() and "<|" not in p:
                tail = p[len(core) :]
                parts.append((p, core, tail))
                cores[core], tails[tail] = memo[core], self.first[tail]
            else:
                cores[p] = None
        for known, store, lead in ((cores, memo, before), (tails, self.first, "")):
            unknown = [k for k, v in known.items() if v is None]
            found = dict(zip(unknown, self._encode([lead + k for k in unknown]), strict=True))
            known.update(found)
            made.update(found if known is cores else {})
            store.room(len(found))
            store.update(found)
        both = {p: cores[core] + tails[tail] for p, core, tail in parts}
        memo.room(len(both))
        memo.update(both)
        return made | both

    def _fill(self, memo: Recent, split: list[list[str]], before: str) -> list[list[bytes]]:
        met = [list(map(memo.__getitem__, s)) for s in split]
        new = {p for s, got in zip(split, met, strict=True) if None in got for p, g in zip(s, got, strict=True) if g is None}
        if not new:
            return met
        made = self._learn(memo, new, before)
        return [[made[p] if g is None else g for p, g in zip(s, got, strict=True)] if None in got else got for s, got in zip(split, met, strict=True)]

    def texts(self, texts: list[str]) -> list[bytes]:
        found: list[bytes] = [b""] * len(texts)
        whole = [i for i, x in enumerate(texts) if self.odd(x)]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            found[i] = ids
        skip = set(whole)
        at = [i for i in range(len(texts)) if i not in skip]
        split = [texts[i].split(" ") for i in at]
        first = self._fill(self.first, [s[:1] for s in split], "")
        later = self._fill(self.later, [s[1:] for s in split], " ")
        for i, a, b in zip(at, first, later, strict=True):
            found[i] = b"".join((*a, *b))
        return found


@lru_cache(maxsize=1)
def pieces_of(path: str, width: int) -> Pieces:
    """One per worker process: what it has met serves its later tasks too."""
    return Pieces(path, width)


def write_shards(docs: DataFrame, path: str, out: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text", shards: int | None = None, width: int = 2) -> DataFrame:
    """Write docs' ids to shards under the folder `out`; returns shard, name, docs, ids, in the order of identifiers.

    Documents are dealt to shards by ranges of the identifier and sorted there (null first; rows with equal identifiers by
    the beginnings of their texts, then by digest). Many rows of one identifier are dealt to several shards in that order; equal
    rows follow each other anyhow. There are as many shards as shuffle partitions, or more for an input of more than
    SHARD_BYTES each. Keys must be whole numbers; other columns are left out; an empty table gives shards without documents.
    Each shard is written under a name of its attempt and then renamed, so a task that runs again leaves one
    whole file. Null texts count as empty: only end_id. width: bytes of an id, 2 or 4.
    """
    spark = docs.sparkSession
    rows = docs.select(whole_number(docs, key).alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n = shards or max(fit_partitions(spark), input_bytes(rows) // SHARD_BYTES)
    order = [F.col("doc_id"), F.substring("text", 1, 64), F.xxhash64("text")]
    rows = rows.withColumn("part", F.rand(7)).repartitionByRange(n, *order, F.col("part")).sortWithinPartitions(*order).drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calm()
        task = TaskContext.get()
        store, base = place(out)
        store.create_dir(base, recursive=True)
        name = f"shard-{task.partitionId():06d}"
        trial = f"{base}/.{name}.{task.taskAttemptId()}"
        end = np.array([] if end_id is None else [end_id], f"<u{width}").tobytes()
        pieces = pieces_of(path, width)
        with store.open_output_stream(trial) as f:
            w = Writer(f, width)
            for part in slices(batches, "text"):
                for i, ids in zip(part.column(0).to_pylist(), pieces.texts(part.column(1).to_pylist()), strict=True):
                    w.add(key_of(i), ids + end)
            w.close()
        store.move(trial, f"{base}/{name}.sst")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "name": [f"{name}.sst"], "docs": [len(w.keys)], "ids": [w.ids]})

    return rows.mapInArrow(run, "shard int, name string, docs bigint, ids bigint")


def read_shards(spark: SparkSession, out: str, written: list) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    written: rows of write_shards, one a shard; from them come the ids before each shard, the only thing that the driver
    gathers.
    """
    before, rows = 0, []
    for r in sorted(written, key=lambda r: r["shard"]):
        rows.append((r["name"], before))
        before += r["ids"]
    names = spark.createDataFrame(rows, "name string, before bigint").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = place(out)
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(str(PurePosixPath(base, name))) as f:
                    reader, got = Reader(f), ([], [], [], [])
                    for key, value in reader:
                        ids = np.frombuffer(value, f"<u{reader.width}")
                        for column, x in zip(got, (id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(x)
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return names.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
