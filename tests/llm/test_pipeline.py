"""The pipeline's stages, each against a plain version on its own input."""

import hashlib
import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracewright.llm.common import table
from tracewright.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, texts = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, DATA)
        rows = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            texts = {r["doc_id"]: r["text"] for r in rows}
            assert texts.items() <= before.items() and len(rows) == len(texts)
        if name == "exact dedup":
            assert texts == {i: x for x, i in {x: i for i, x in sorted(before.items())}.items()}
        if name == "benchmark decontamination":
            words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.encode().lower().decode())
            windows = {tuple(w[i : i + 10]) for r in table(spark, DATA, "benchmark").collect() if (w := words(r["text"])) for i in range(max(1, len(w) - 9))}
            leaks = {i for i, x in before.items() if any(tuple(w[k : k + 10]) in windows for w in [words(x)] for k in range(len(w)))}
            assert set(texts) == set(before) - leaks
        docs = spark.createDataFrame(rows, out.schema) if out.columns == columns else docs
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_equals_its_stages(spark):
    docs = table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()}


def test_good_documents_stay(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    kept = corpus_pipeline.good_only(spark, docs, DATA)
    good = labels.where("quality = 1").join(docs, "doc_id", "left_semi")
    assert good.join(kept, "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_queries_cover_all_rows(spark):
    n = {"op2_url_filter": table(spark, DATA, "pages").count()}
    for name, q in QUERIES.items():
        if name in ("op1_token_counts", "op2_url_filter", "op7_token_shards"):
            assert q(spark, DATA).agg(F.count(F.lit(1))).first()[0] == n.get(name, table(spark, DATA, "documents").count())
