"""The pipeline's quality and near-copy stages, row for row."""

import re

import numpy as np

import corpus_pipeline
from tracewright.llm import near_dup, quality
from tracewright.llm.common import Memo, cut, table

DATA = "/root/testdata/sf0.001"


def test_quality_stage_keeps_what_the_model_scores(spark):
    docs = table(spark, DATA, "documents")
    model = quality.fit(docs, table(spark, DATA, "labels"), "quality", quality.fold("doc_id", 3) != 1)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = set()
    for i, x in rows:  # one text at a time, its score from its features
        feature = np.unique(quality.features([x or ""], Memo(quality.code, 1000))[1])
        if 1 / (1 + np.exp(-(model.slope * (float(model.weight[feature].sum(dtype=np.float64)) + model.bias) + model.offset))) >= 0.5:
            want.add(i)
    assert {r["doc_id"] for r in corpus_pipeline.good_only(spark, docs, DATA).select("doc_id").collect()} == want
    assert 0 < len(want) < len(rows)


def test_near_copy_stage_keeps_the_least_of_each_component(spark):
    docs = cut(corpus_pipeline.without_copies(spark, table(spark, DATA, "documents"), DATA))
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").encode().lower().decode())
        sets[r["doc_id"]] = {tuple(w[j : j + near_dup.WORDS]) for j in range(len(w) - near_dup.WORDS + 1)} if len(w) >= near_dup.WORDS else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and (both := len(sets[i] & sets[j])) and 100 * both >= near_dup.PERCENT * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    want = {i for i in ids if find(i) == i}
    assert {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, DATA).select("doc_id").collect()} == want
    assert len(want) < len(ids)
