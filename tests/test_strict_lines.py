"""Strict JSON lines: faults by file and line, over files that are read in many ranges."""

import json

import pytest

from tracewright.sources import strict_lines


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def lines_of(n, tag):
    return [json.dumps({"i": i, "tag": tag, "pad": "x" * (i % 90)}) for i in range(n)]


def by_hand(path):
    found = []
    for k, line in enumerate(path.read_text().split("\n"), 1):
        if line.strip():
            try:
                good = isinstance(json.loads(line), dict)
            except ValueError:
                good = False
            if not good:
                found.append((path.name, k))
    return found


def test_faults_in_any_range_are_named(spark, tmp_path, small_ranges):
    first, second = lines_of(900, "a"), lines_of(40, "b")
    first[700] = '{"i": 700'  # beyond the second range
    first[5] = ""
    first[6] = "   \t "
    first[650], first[12], first[899] = "[1, 2]", '{"i": 1} trailing', "nothing"
    second[39] = "null"
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text("\n".join(first) + "\n")
    b.write_text("\n".join(second))
    assert spark.read.text(str(a)).rdd.getNumPartitions() >= 3
    rows = strict_lines.faults(spark, str(tmp_path)).collect()
    assert sorted((r["file"].split("/")[-1], r["line"]) for r in rows) == sorted(by_hand(a) + by_hand(b))
    assert {r["line"]: r["reason"].split(":")[0] for r in rows if r["file"].endswith("a.jsonl")} == {13: "invalid JSON", 651: "row must be an object", 701: "invalid JSON", 900: "invalid JSON"}
    with pytest.raises(ValueError, match=r"a\.jsonl:13 invalid JSON"):
        strict_lines.strict_json_lines(spark, str(tmp_path), "i int")
    with pytest.raises(ValueError, match=r"b\.jsonl:40 row must be an object"):
        strict_lines.strict_json_lines(spark, str(b), "i int")


def test_sound_files_are_read_whole(spark, tmp_path, small_ranges):
    path = tmp_path / "good.jsonl"
    path.write_text("\r\n".join([*lines_of(900, "a"), "", " ", '{"i": "no number", "more": 1}']))
    rows = strict_lines.strict_json_lines(spark, str(path), "i int, tag string", non_empty=True)
    assert rows.count() == 901 and rows.columns == ["i", "tag"] and rows.where("i is null").count() == 1


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "blank.jsonl").write_text("\n  \n")
    (tmp_path / "one.jsonl").write_text('{"i": 1}\n')
    assert {f.split("/")[-1] for f in strict_lines.files_without_rows(spark, str(tmp_path))} == {"empty.jsonl", "blank.jsonl"}
    with pytest.raises(ValueError, match=r"blank\.jsonl has no rows"):
        strict_lines.strict_json_lines(spark, str(tmp_path), "i int", non_empty=True)
    assert strict_lines.strict_json_lines(spark, str(tmp_path), "i int").count() == 1
