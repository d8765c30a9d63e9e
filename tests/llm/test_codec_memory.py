"""What the codec holds of a segment: numbers and ids of its distinct runs, of one segment at a time."""

import tracemalloc
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tracewright.llm import bpe_codec
from tracewright.llm.wordbpe import load

WORD = public_tokenizers.path("word_bpe_49k.json")


def distinct_runs(n: int) -> list[str]:
    """Texts of n distinct runs in all, some of which hold several words."""
    rng = np.random.default_rng(5)
    runs = ["".join(map(chr, rng.integers(97, 123, 8))) + ("", ",", "'s")[i % 3] for i in range(n)]
    assert len(set(runs)) == n
    return [" ".join(runs[i : i + 200]) for i in range(0, n, 200)]


def test_a_run_takes_few_bytes():
    bpe, n = load(WORD), 30_000
    texts = distinct_runs(n)
    bpe_codec.Codec(bpe, [texts[:1]], arrays=True).text(texts[0])  # what is compiled once
    tracemalloc.start()
    try:
        codec = bpe_codec.Codec(bpe, [texts], arrays=True)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 300 * n and peak < 650 * n
    lib = Tokenizer.from_file(WORD)
    for x in texts[::50]:
        want = lib.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(codec.text(x)[3]), "<i4").tolist() == want


def test_one_segment_at_a_time(spark, monkeypatch):
    alive, most = weakref.WeakSet(), []

    class Seen(bpe_codec.Codec):
        def __init__(self, *a, **b):
            alive.add(self)
            most.append(len(alive))
            super().__init__(*a, **b)

    monkeypatch.setattr(bpe_codec, "Codec", Seen)
    monkeypatch.setattr(bpe_codec, "SEGMENT", 1)
    monkeypatch.setattr(bpe_codec, "map_arrow", lambda df, run, schema: run)
    texts = ["one two", None, "", "three <|endoftext|> é", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    run = bpe_codec.codec_digests(docs, WORD, ids=True)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": pa.array([x], pa.string())}) for i, x in enumerate(texts)]
    lib, got = Tokenizer.from_file(WORD), [r for b in run(iter(batches)) for r in b.to_pylist()]
    assert [r["ids"] for r in got] == [lib.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert most and max(most) == 1


def test_pairs_come_in_stretches(monkeypatch):
    bpe, words = load(WORD), ["a" * n for n in range(1, 40)] + distinct_runs(200)[0].split() + ["café", "x"]
    for n in (1, 7, 64, 1 << 17):
        monkeypatch.setattr(bpe_codec, "STRETCH", n)
        assert bpe_codec.index_encode(bpe, words) == [bpe.merge(w) for w in words]
