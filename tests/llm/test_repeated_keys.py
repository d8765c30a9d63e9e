"""Rows of one key and different texts in the n-gram Jaccard join."""

from collections import Counter

from tracewright.llm import near_dup


def test_repeated_keys_are_told_apart_by_their_texts(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (2, f"{a} more"), (2, b), (3, f"{b} more"), (5, c), (5, c), (6, c), (7, ""), (7, ""), (None, c), (8, "x y"), (8, "z w")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter(tuple(r) for r in near_dup.drop_near(frame).collect())
    assert got == Counter([(1, a), (2, b), (5, c), (7, ""), (7, ""), (None, c), (8, "x y"), (8, "z w")])
    named = {(r["doc_id"], r["component_id"]) for r in near_dup.jaccard_classes(frame).collect()}
    assert named == {(1, 1), (2, 1), (2, 2), (3, 2), (5, 5), (6, 5), (7, 7), (None, 5), (8, 8)}
