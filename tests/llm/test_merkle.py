"""The Merkle manifest against a plain version, over odd rows, every partitioning and tampered rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import merkle

FIELDS = ["doc_id", "source", "text"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes, base):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + base])) for i in range(0, len(nodes), base)]
        found.append(nodes)
    return found


def way(levels, i, base):
    for nodes in levels[:-1]:
        begins = i - i % base
        yield "".join(nodes[begins:i]), "".join(nodes[i + 1 : begins + base])
        i //= base


def plain(rows, base, altered=lambda i, x: x):
    leaf = lambda i, s, x: sha(field(i) + field(s) + field(x))
    groups = {}
    for i, s, x in rows:
        groups.setdefault(s, []).append(((i is not None, i or 0), leaf(i, s, x), leaf(i, s, altered(i, x)), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([r[1] for r in sorted(groups[s], key=lambda r: r[:2])], base) for s in names}
    over = levels_of([trees[s][-1][0] for s in names], base)
    found = []
    for k, s in enumerate(names):
        for j, (_, own, other, i) in enumerate(sorted(groups[s], key=lambda r: r[:2])):
            steps = [*way(trees[s], j, base), *way(over, k, base)]
            folded = other
            for left, right in steps:
                folded = sha(left + folded + right)
            found.append((i, own, trees[s][-1][0], over[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == over[-1][0]))
    return Counter(found)


def rows_of(seed, n):
    rng = np.random.default_rng(seed)
    names = [None, "", "a", "é", "z", "hot", "hot", "hot", "hot"]
    rows = [(int(i), names[rng.integers(len(names))], f"text {i}\nmore" if rng.random() < 0.5 else f"plain {i}") for i in rng.permutation(n)]
    odd = [(None, "hot", "no key"), (None, None, None), (5, "hot", None), (5, "hot", None), (5, "hot", "other"), (7, "alone", ""), (-3, "hot", "x" * 200_000), (2**40, "", "\n\n")]
    return rows + odd


def got(spark, rows, base, altered=None):
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumns({c: F.lit("mine") for c in ("g", "part", "pos", "digest", "key", "way", "level", "other", "name")})
    found = merkle.proofs(frame, FIELDS, base=base, altered=altered)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize(("n", "base", "parts"), [(300, 3, 4), (300, 2, 7), (40, 3, 13), (1, 3, 4), (9, 3, 2)])
def test_proofs(spark, n, base, parts):
    rows = rows_of(n, n)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
        altered = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
        plainly = lambda i, x: x.replace("\n", "") if i is not None and x is not None and zlib.crc32(str(i).encode()) % 2 == 0 else x
        assert got(spark, rows, base, altered) == plain(rows, base, plainly)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_row_one_group_and_no_row(spark):
    assert got(spark, [(1, None, "x")], 3) == plain([(1, None, "x")], 3)
    rows = [(i, "only", "same") for i in range(28)]
    assert got(spark, rows, 3) == plain(rows, 3)
    empty = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert merkle.proofs(empty, FIELDS).count() == merkle.manifest(empty, FIELDS).count() == merkle.node_records(empty, FIELDS).count() == 0


def test_manifest_and_node_records(spark):
    rows = rows_of(3, 200)
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    want = plain(rows, 3)
    roots = merkle.manifest(frame, FIELDS).collect()
    assert {(r["subroot"], r["root"]) for r in roots} == {(x[2], x[3]) for x in want} and sum(r["n"] for r in roots) == len(rows)
    groups = {}
    for i, s, x in rows:
        groups.setdefault(s, []).append(((i is not None, i or 0), sha(field(i) + field(s) + field(x))))
    nodes = Counter((s, len(g), k, j, d) for s, g in groups.items() for k, level in enumerate(levels_of([x[1] for x in sorted(g)], 3)) for j, d in enumerate(level))
    assert Counter(tuple(r) for r in merkle.node_records(frame, FIELDS).collect()) == nodes


def test_ranges_of_any_cut():
    for base in (2, 3, 5):
        for n in (1, 2, 3, 4, 10, 28, 82):
            leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
            want = levels_of([x.hex() for x in leaves], base)
            rng = np.random.default_rng(n)
            cuts = sorted({0, n, *rng.integers(0, n + 1, 4).tolist()})
            peaks = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                made = merkle.Range(a, n, base)
                for x in leaves[a:b]:
                    made.push(x)
                assert all(want[k][i] == d.hex() for k, i, d in made.nodes())
                assert len(made.peaks()) <= 2 * (base - 1) * (made.top + 1)
                peaks += made.peaks()
            found = merkle.climb(peaks, n, merkle.height(n, base), base)
            assert {f[2].hex() for f in found} == {want[-1][0]}
