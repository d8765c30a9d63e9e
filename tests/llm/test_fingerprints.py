"""Fingerprints against a plain version, their algebra, and documents edited with their next one."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import fingerprints as fp

LONG = "\n".join(" ".join(f"w{(i * j) % 911}" for j in range(40)) for i in range(3_000))
ODD = [
    (1, None), (2, ""), (3, "x"), (4, LONG), (5, "a" * 4_000), (6, "same text  here\nand more"), (7, "same text  here\nand more"), (7, "same text  here\nand more"), (7, "other text of seven"),
    (None, "no key at all"), (None, None), (9, "\n\n"), (10, "é İ 汉字 😀 one\ntwo 😀😀"), (11, "one two"), (-5, "far below the rest"), (2**40, "last of all, one two three\nfour"),
]


def one(text):
    return fp.sums([text.split("\n")])


def plain_lanes(text):
    """Distinct shingles of each paragraph, one place each, from the same hashes but one at a time."""
    lanes = np.zeros(fp.LANES, np.int64)
    for p in text.split("\n"):
        words = p.split()
        grams = {tuple(words[i : i + fp.WORDS]) for i in range(len(words) - fp.WORDS + 1)} if len(words) >= fp.WORDS else {tuple(words)} if words else set()
        for g in grams:
            at, h = fp._shingles([" ".join(g)])
            assert len(at) == 1
            lanes[int(h[0] >> np.uint64(1)) % fp.LANES] += 1 if int(h[0]) & 1 else -1
    return lanes % (1 << fp.LANE_BITS)


def test_sums_are_of_distinct_shingles_and_whole_paragraphs():
    for text in ("", "a", "a b", "a b c", "a b c d a b c d", "x y\nx y\n\nz", "one two three four\none two three", "é 汉字 w\x85q"):
        got = one(text)
        assert got.lanes[0].tolist() == plain_lanes(text).tolist()
        whole = sum(np.frombuffer(hashlib.blake2b(p.encode(), digest_size=32).digest(), "<u8").astype(object) for p in text.split("\n")) % (1 << 64)
        assert got.whole[0].astype(object).tolist() == whole.tolist()


def test_order_insertion_and_deletion():
    a, b = "first line\nsecond line here\nthird", "third\nfirst line\nsecond line here"
    assert one(a).texts() == one(b).texts() != one("first line\nsecond line here").texts()
    assert (one(a) - fp.sums([["third"]])).texts() == one("first line\nsecond line here").texts()
    assert (one("x") + one("y")).texts() == one("x\ny").texts()
    assert one("x\nx").texts() != one("x").texts()
    several = fp.sums([["x", "y"], [], ["z"]])
    assert several[:1].texts() == one("x\ny").texts() and several[2:].texts() == one("z").texts() and not several.lanes[1].any()
    back = fp.read(several.texts())
    assert (back.whole == several.whole).all() and (back.lanes == several.lanes).all()


def test_likeness_is_near_the_share_of_shingles():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.3, 0.8, 0.95):
        apart = []
        for _ in range(30):
            words = [f"w{i}" for i in rng.integers(10**9, size=600)]
            other = [f"v{i}" for i in rng.integers(10**9, size=600)]
            n = int(600 * share)
            apart.append(float(fp.likeness(one(" ".join(words)), one(" ".join(words[:n] + other[n:])))[0]) - share)
        assert max(map(abs, apart)) < 4 / fp.LANES**0.5 and abs(np.mean(apart)) < 0.05
    assert fp.likeness(one("same words here"), one("same words here")).tolist() == [1.0]
    assert fp.likeness(one(""), one("")).tolist() == [1.0] and fp.likeness(one(""), one("x")).tolist() == [0.0] and fp.likeness(one(""), one("\n")).tolist() == [0.0]


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_next_edits(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        frame = spark.createDataFrame(ODD, "doc_id bigint, text string").repartition(3)
        hashes = {(r[0], r[1]): r[2] for r in frame.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
        rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r]))
        want = Counter()
        for (i, x), (_, y) in zip(rows, rows[1:] + rows[:1], strict=True):
            x, y = x or "", y or ""
            edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
            near = [round(float(fp.likeness(one(x), one(z))[0]), 12) for z in (edited, y)]
            want[i, len(x), hashlib.sha256(edited.encode()).hexdigest(), one(x).texts()[0], one(edited).texts()[0], *near] += 1
        found = fp.next_edits(frame.withColumns({c: F.lit("mine") for c in ("k", "h", "part", "edge", "fingerprint")}))
        assert Counter((*tuple(r)[:5], round(r[5], 12), round(r[6], 12)) for r in found.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_document_and_none(spark):
    frame = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    (r,) = fp.next_edits(frame).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1
    assert fp.next_edits(frame.limit(0)).count() == 0 == fp.fingerprints(frame.limit(0)).count()


def test_columns_of_fingerprints(spark):
    frame = spark.createDataFrame([(1, "a b c\nd", ["x"]), (2, None, None)], "doc_id bigint, text string, more array<string>")
    found = fp.fingerprints(frame).join(frame, "doc_id").withColumn("grown", fp.inserted("fingerprint", "more")).withColumn("back", fp.deleted("grown", "more"))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows[1]["grown"] == one("a b c\nd\nx").texts()[0] and rows[1]["back"] == rows[1]["fingerprint"] and rows[2]["grown"] == rows[2]["fingerprint"] == one("").texts()[0]
    assert fp.total(found.repartition(2)) == (one("a b c\nd") + one("")).texts()[0]
