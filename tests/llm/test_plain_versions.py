"""Learnt and streamed parts against plain versions of themselves, and rows, names and keys that get in the way."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, decontaminate, exact_dedup, line_dedup, near_dup, quality, token_shards, toxicity

# -- quality: ratios, hinge loss and calibration in plain Python


def svm_by_hand(rows, label, dim, cost, epochs=400):
    """Ratios, and the L1-loss SVM on the scaled indicators by projected gradient steps on its dual."""
    sums = [[1.0] * dim, [1.0] * dim]
    for x, y in zip(rows, label, strict=True):
        for f in x:
            sums[y][f] += 1
    ratio = [math.log(sums[1][f] / sum(sums[1])) - math.log(sums[0][f] / sum(sums[0])) for f in range(dim)]
    sign = [1.0 if y else -1.0 for y in label]
    dot = lambda a, b: sum(ratio[f] ** 2 for f in set(a) & set(b)) + 1.0
    q = [[sign[i] * sign[j] * dot(rows[i], rows[j]) for j in range(len(rows))] for i in range(len(rows))]
    alpha = [0.0] * len(rows)
    for _ in range(epochs):
        for i in range(len(rows)):
            slope = sum(q[i][j] * alpha[j] for j in range(len(rows))) - 1
            alpha[i] = min(max(alpha[i] - slope / q[i][i], 0.0), cost)
    weight = [sum(alpha[i] * sign[i] * ratio[f] for i in range(len(rows)) if f in rows[i]) for f in range(dim)]
    return ratio, weight, sum(alpha[i] * sign[i] for i in range(len(rows)))


def test_support_vectors_are_those_of_the_plain_version():
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 40).astype(bool)
    rows = [sorted({int(f) for f in rng.integers(0, 12, 5)} | ({12 + int(rng.integers(0, 3))} if y else set())) for y in label]
    ratio, weight, bias = svm_by_hand(rows, [int(y) for y in label], 16, 0.1)
    arrays = [np.array(x) for x in rows]
    got = quality.log_count_ratio(arrays, label)
    rest = quality.DIM - 16  # features that no row has take part in the sums
    p, q = (sum(sum(f in x for x, z in zip(rows, label, strict=True) if z == y) + 1 for f in range(16)) for y in (True, False))
    assert np.allclose(got[:16], [r + math.log(p / (p + rest)) - math.log(q / (q + rest)) for r in ratio])
    scale = np.zeros(quality.DIM)
    scale[:16] = ratio
    w = quality.dual_descent(arrays, scale, label, np.full(40, 0.1), epochs=3_000, tol=1e-9)
    assert np.allclose(w[:16], weight, atol=1e-4) and abs(w[-1] - bias) < 1e-4


def test_calibration_is_the_best_logistic_function():
    rng = np.random.default_rng(5)
    margin, weight = rng.normal(0, 2, 300), rng.uniform(0.5, 2, 300)
    label = (rng.random(300) < 1 / (1 + np.exp(-1.3 * margin + 0.4))).astype(int)
    a, b = quality.platt(margin, label, weight)
    n, m = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (n + 1) / (n + 2), 1 / (m + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum()

    best = loss(a, b)
    assert all(loss(a + x, b + y) >= best - 1e-6 for x in (-0.01, 0, 0.01) for y in (-0.01, 0, 0.01))


def test_features_are_distinct_shape_ngrams():
    texts = ["Hello, World 12", "", "aa aa aa bb", "x" * 150 + " y"]
    doc, feature = quality.features(texts, common.Memo(quality.code, 1_000))
    for i, x in enumerate(texts):
        words = quality.pieces(x)
        shapes = [(quality.shape(w), k > 0 and words[k - 1] == w) for k, w in enumerate(words)]
        grams = {tuple(shapes[k : k + n]) for n in (1, 2, 3) for k in range(len(shapes) - n + 1)}
        assert (doc == i).sum() == len(grams) == len(set(feature[doc == i].tolist()))
    assert "".join(quality.pieces(texts[3])) == texts[3].replace(" ", "")


def test_a_sample_of_too_many_bytes_is_cut_in_its_order(spark):
    rows = spark.createDataFrame([(i, i % 2, bytes(100)) for i in range(50)], "doc_id bigint, _label int, x binary")
    kept = quality._within(rows, "doc_id", 1_000).collect()
    assert Counter(r["_label"] for r in kept) == {0: 5, 1: 5}
    assert quality._within(rows, "doc_id", 5_000).count() == 50


# -- toxicity: log-odds, extreme values and evidence in plain Python


def test_log_odds_decay_and_evidence_are_those_of_the_plain_version():
    rng = np.random.default_rng(6)
    n = rng.integers(50, 4_000, 60)
    z, y = rng.binomial(n, 0.2), rng.binomial(n, 0.02)
    y[:6] = rng.integers(60, 90, 6)
    got = toxicity.log_odds(y.astype(float), z.astype(float), n, 2_000, 30_000, 120_000)
    chosen = []
    for i in range(60):
        prior = toxicity.PRIOR * n[i] / 120_000
        odds = lambda c, of, prior=prior: math.log((c + prior) / (of + toxicity.PRIOR - c - prior))
        s, e = odds(y[i], 2_000) - odds(z[i], 30_000), math.sqrt(1 / (y[i] + prior) + 1 / (z[i] + prior))
        assert abs(got.score[i] - s) < 1e-9
        if s > 0 and s / e >= toxicity.LEAST_Z:
            chosen.append(i)
    assert got.chosen.tolist() == chosen and len(chosen) >= 6
    score, share = got.score[got.chosen], got.background[got.chosen]
    x = toxicity.decay(score, share)
    assert abs(sum(p * math.exp(x * s) for p, s in zip(share, score, strict=True)) + (1 - share.sum()) * math.exp(toxicity.GAP * x) - 1) < 1e-6
    model = toxicity.Model({}, x, 0.2)
    scores = [9.0, 4.0, 0.5, 30.0]
    chance = [1 - math.exp(-0.2 * 500 * math.exp(-x * s)) for s in scores]
    assert all(abs(model.chance(s, 500) - p) < 1e-9 for s, p in zip(scores, chance, strict=True))
    powers = sorted((-math.log10(max(p, 1e-300)) for p in chance), reverse=True)
    want = min(60.0, powers[0] + 0.5 * sum(p for p in powers[1:] if p > -math.log10(toxicity.SIGNIFICANT)))
    assert abs(toxicity.evidence(model, 500, scores) - want) < 1e-6


def test_units_are_counted_over_all_documents(spark):
    texts = ["Idiots idiot idiots", "an idiom", None, "", "idi x"] * 40
    got, total = toxicity._all_counts(spark.createDataFrame([(x,) for x in texts], "text string").repartition(3), ["idi-", "idiot", "none", "an"], "text")
    held = [{w for w in re.findall(r"[^\W\d_]+", (x or "").lower())} for x in texts]
    assert total == sum(map(len, held))
    assert got.tolist() == [sum(u in toxicity.units(w) for ws in held for w in ws) for u in ("idi-", "idiot", "none", "an")]


def test_planted_words_are_found_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels.where("toxic is not null"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    found = sum(r["toxic"] and r["predicted"] for r in got)
    assert found >= 0.9 * sum(r["toxic"] for r in got) and found >= 0.95 * sum(r["predicted"] for r in got)


# -- line deduplication: the stream over any cut into tasks and batches


@pytest.mark.parametrize("seed", range(6))
def test_lines_are_judged_alike_however_the_rows_are_cut(seed):
    rng = np.random.default_rng(seed)
    rows = sorted({(int(rng.integers(0, 6)), 0, -int(rng.integers(0, 9)), 0, int(rng.integers(0, 4))) for _ in range(200)})
    rows = [(h, a, None if d == 0 else -d, t, at) for h, a, d, t, at in rows]
    rows.sort(key=lambda r: (r[0], r[1], -(r[2] or 0), r[3], r[4]))
    first, count = {}, {}
    for h in {r[0] for r in rows}:
        docs = {r[2] for r in rows if r[0] == h}
        first[h], count[h] = max((d for d in docs if d is not None), default=None), len(docs)
    want = Counter(r for r in rows if count[r[0]] >= 3 and r[2] != first[r[0]])
    schema = pa.schema([(n, pa.int64()) for n in ("h1", "h2", "doc_id", "text_hash", "at")])
    cuts = np.sort(rng.integers(0, len(rows) + 1, 5)).tolist()
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        batches, at = [], a
        while at < b:
            step = int(rng.integers(1, 12))
            batches.append(pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[at : min(b, at + step)]], schema))
            at += step
        for part in line_dedup._streamed(3)(iter(batches)):
            out += [tuple(x.values()) for x in part.to_pylist()]
    seen = {}
    for kind, h1, h2, d, *_ in out:
        if kind == line_dedup.WITNESS:
            seen.setdefault((h1, h2), set()).add(d)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in seen.items() if len(v) >= 3}
    got = Counter(r[1:] for r in out if r[0] == line_dedup.GONE)
    got += Counter(r[1:] for r in out if r[0] == line_dedup.OPEN and r[1:3] in last and r[3] != last[r[1:3]])
    assert got == want


def test_one_common_line_in_small_batches(spark):
    rows = [(i, "\n".join(["the very same line in all of them"] * (1 + i % 3) + [f"own line number {i} of this text"])) for i in range(700)]
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {i: 0 if i == 699 else 1 + i % 3 for i, _ in rows}


def test_bitmaps_by_shuffle_are_those_by_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"a line that many others have\nown {i}") for i in range(50)], "doc_id bigint, text string")
    want = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.line_dedup(rows).collect()}
    monkeypatch.setattr(line_dedup, "SMALL_BITMAPS", 0)
    assert {r["doc_id"]: r["kept_sha256"] for r in line_dedup.line_dedup(rows).collect()} == want


# -- near copies


NEAR = [f"w{i}" for i in range(60)]


def changed(*at):
    return " ".join("x" if i in at else w for i, w in enumerate(NEAR))


def test_a_row_without_a_key_joins_two_others(spark):
    rows = [(10, changed(0)), (None, changed()), (20, changed(59)), (30, "quite another text than all of these")]
    far = near_dup.shingle_sets([changed(0, 1, 2, 3, 4), changed(), changed(55, 56, 57, 58, 59)])
    both = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert both(far[0], far[1]) > 0.85 and both(far[0], far[2]) < 0.85
    for null_id, want in ((None, {10: 10, 20: 10, 30: 30, None: 10}), (15, {10: 10, 20: 10, 30: 30, 15: 10})):
        frame = spark.createDataFrame([(10, changed(0, 1, 2, 3, 4)), (null_id, rows[1][1]), (20, changed(55, 56, 57, 58, 59)), rows[3]], "doc_id bigint, text string")
        assert {r["doc_id"]: r["component_id"] for r in near_dup.jaccard_classes(frame).collect()} == want


def test_members_that_the_star_leaves_meet_all_others(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "STAR_MEMBERS", 4)
    monkeypatch.setattr(near_dup, "TILE_MEMBERS", 6)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):  # a drifting chain: neighbours link, far ones do not
        words = [f"w{(k if k >= i // 3 else k + 1000)}" for k in range(80)]
        if rng.random() < 0.3:
            words[79] = f"y{i}"
        rows.append((i, " ".join(words)))
    sets = near_dup.shingle_sets([x for _, x in rows])
    up = list(range(120))
    for i in range(120):
        for j in range(i):
            b = len(np.intersect1d(sets[i], sets[j]))
            if 100 * b >= 85 * (len(sets[i]) + len(sets[j]) - b):
                a, c = sorted((up[i], up[j]))
                up = [a if x == c else x for x in up]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.jaccard_classes(frame).collect()} == dict(enumerate(up))


def test_hashes_that_fall_together_when_cut_short():
    names = np.array([(1, 2), (3, 4)], near_dup._NAME)
    raw = near_dup._packed(names, np.array([0, 1, 1]), np.array([7, 1 << 40, 9], near_dup.U), np.array([2, 2, 5]))
    entries = near_dup._Entries()
    entries.add(raw)
    entries.add(raw)
    got, of, h, df = entries.all()
    assert got.tolist() == [(1, 2), (3, 4)] and of.tolist() == [0, 1, 1] * 2 and h.tolist() == [7, 1 << 40, 9] * 2 and df.tolist() == [2, 2, 5] * 2


# -- benchmarks beyond one block


def test_spans_go_alike_in_one_block_and_in_many(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"t{i}" for i in range(40)]
    item = lambda n: " ".join(rng.choice(words, n))
    items = [("a", item(200)), ("b", item(30)), ("c", "lonely"), ("d", item(12)), (None, item(15)), ("e", "")]
    long = items[0][1].split()
    texts = [" ".join(["Own", *long[k : k + 25], "words,", *items[1][1].split()[5:20], "end", "LONELY"]) for k in range(0, 150, 10)] + [None, "", "nothing here"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id bigint, text string").withColumns({c: F.lit("mine") for c in ("hits", "digest", "hash", "_key")})
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = lambda f: Counter(tuple(r) for r in f.collect())
    monkeypatch.setattr(decontaminate, "PIECE", 17)
    whole = [rows(decontaminate.contamination(docs, bench)), rows(decontaminate.decontaminate(docs, bench, "spans")), rows(decontaminate.decontaminate(docs, bench, "documents"))]
    blocks = [rows(decontaminate.contamination(docs, bench, most=60)), rows(decontaminate.decontaminate(docs, bench, "spans", most=60)), rows(decontaminate.decontaminate(docs, bench, "documents", most=60))]
    assert blocks == whole
    assert sum(n for r, n in whole[1].items() if "Own" in (r[1] or "") and "LONELY" not in r[1]) == 16


# -- names, keys and the session


RESERVED = ["_key", "_digest", "_gone", "digest", "keep", "gone_id", "gone_digest", "n", "k", "k1", "k2", "s1", "s2", "_id", "_hash", "id", "hash", "hits", "part", "i", "root"]


def test_columns_with_the_operators_own_names(spark):
    rows = [(1, changed()), (2, changed()), (2, changed()), (3, changed(5)), (4, "lonely text of its own here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in RESERVED})
    bench = spark.createDataFrame([("a", "lonely text of its own here")], "item_id string, text string")
    model = quality.Model(np.zeros(quality.DIM), 0.0, 0.0, 0.0)
    for made, ids in (
        (exact_dedup.drop_exact(docs), [2, 3, 4]), (near_dup.drop_near(docs), [1, 4]), (decontaminate.decontaminate(docs, bench, "documents"), [1, 2, 2, 3]),
        (decontaminate.decontaminate(docs, bench, "documents", most=0 + 1), [1, 2, 2, 3]), (quality.accepted(docs, model), [1, 2, 2, 3, 4]),
        (line_dedup.with_bitmaps(docs).drop("_bitmap"), [1, 2, 2, 3, 4]),
    ):
        assert made.columns == docs.columns
        got = made.collect()
        assert sorted(r["doc_id"] for r in got) == ids and all(r[c] == c for r in got for c in RESERVED)


def test_keys_must_be_whole_numbers(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (line_dedup.line_dedup, near_dup.jaccard_classes, near_dup.drop_near, lambda d: token_shards.write_shards(d, "", "")):
        with pytest.raises(TypeError, match="whole numbers"):
            f(docs)
    assert exact_dedup.drop_exact(docs).count() == 1


def test_the_sessions_settings_stay(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(i, f"text {i % 3} with a line long enough") for i in range(9)], "doc_id bigint, text string")
    line_dedup.line_dedup(docs).count()
    near_dup.jaccard_classes(docs).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_many_rows_of_one_identifier_fill_several_shards(spark, tmp_path):
    import public_tokenizers

    path, texts = public_tokenizers.path("byte_bpe_50k.json"), [f"text {i % 40}" for i in range(400)]
    docs = spark.createDataFrame([(None, x) for x in texts], "doc_id bigint, text string")
    rows = token_shards.write_shards(docs, path, f"file://{tmp_path}/s", shards=4).collect()
    assert sum(r["docs"] > 0 for r in rows) >= 3
    got = token_shards.read_shards(spark, f"file://{tmp_path}/s", rows).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    one = {r["ids_crc32"] for r in got}
    assert len(one) == 40 and len(got) == 400 and all(zlib.crc32(b"") != x for x in one)


@pytest.mark.parametrize("seed", range(3))
def test_url_threshold_parts_labelled_rows_best(spark, seed):
    from tracewright.llm import url_filter

    rng = np.random.default_rng(seed)
    rows = [(float(rng.normal(0.8 if y else -0.4, 1)), bool(y)) for y in rng.integers(0, 2, 120)]
    best = url_filter.threshold(spark.createDataFrame(rows, "value double, allowed boolean"))
    good, bad = [v for v, y in rows if y], [v for v, y in rows if not y]
    gain = lambda t: sum(v >= t for v in good) / len(good) + sum(v < t for v in bad) / len(bad)
    step = 20 / url_filter.BINS
    assert gain(best) >= max(gain(np.floor(v / step) * step + k * step) for v, _ in rows for k in (0, 1)) - 1e-9
    assert url_filter.threshold(spark.createDataFrame(rows[:0], "value double, allowed boolean")) == 0.0


def test_the_planner_knows_the_size_of_files_alone(spark):
    from tracewright.llm.common import input_bytes, table

    files = table(spark, "/root/testdata/sf0.01", "documents")
    assert 100_000 < input_bytes(files) < 100_000_000
    assert input_bytes(spark.createDataFrame([(1, "x")], "doc_id bigint, text string")) == 0


# -- decontamination: blocks of a large benchmark stay within their bound


def test_blocks_hold_their_bound_whatever_repeats(spark):
    rows = [("same", " ".join(f"w{i}" for i in range(30)))] * 500
    rows += [(f"other{k}", " ".join(f"w{i}" for i in range(30))) for k in range(300)]
    rows += [("long", " ".join(f"v{i}" for i in range(5_000))), ("short", "one two"), (None, "one two"), ("none", None)]
    benchmark = spark.createDataFrame(rows, "item_id string, text string").repartition(7)
    for most in (1_500, 10**6):
        made = [m() for m in decontaminate._blocks(benchmark, 10, "item_id", "text", most)]
        sizes = [sum(len(names) for by in x.sets.values() for same in by.values() for _, names in same) for x in made]
        assert max(sizes) <= most and sum(sizes) == 301 * 21 + 4_991 + 2
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 25))), (2, "one two three"), (3, "v0 v1")], "doc_id int, text string")
    want = {tuple(r) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert {tuple(r) for r in decontaminate.contamination(docs, benchmark, most=4_000).collect()} == want and {r[0]: r[3] for r in want} == {1: 301, 2: 2, 3: 0}
