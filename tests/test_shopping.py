"""Shopping metrics and trainer records on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import planning, records, shopping, trace_rows


def test_purchases_and_ways(spark):
    rows = spark.createDataFrame(
        [("a", "", ["", ' {"asin": "b1", "options": {"z": 1, "a": "é"}} ', None], ["search[x]", "click[buy now]"]), ("b", "opaque", [], ["go"]), ("c", None, [], ["click[b00abc1234]"])],
        "trajectory_id string, own string, calls array<string>, actions array<string>",
    )
    rows = rows.withColumn("signature", shopping.purchase(F.col("own"), F.col("calls")))
    got = {r["trajectory_id"]: r for r in rows.select("*", shopping.canonical_purchase("signature").alias("one"), *(shopping.strategy_key(F.col("actions"), F.col("signature"), k).alias(k) for k in shopping.KEYS[:3])).collect()}
    assert got["a"]["one"] == json.dumps({"asin": "B1", "options": {"a": "é", "z": 1}}, separators=(",", ":")) and got["b"]["one"] == "opaque" and got["c"]["one"] == ""
    assert [got[k]["purchase_signature"] for k in "bc"] == ["opaque", '["click[b00abc1234]"]']
    assert got["a"]["action_type_trace"] == "search > click:buy now" and got["a"]["action_trace"] == '["search[x]", "click[buy now]"]'
    both = shopping.strategy_key(F.col("actions"), F.col("signature"), shopping.KEYS[3])
    assert json.loads(rows.where("trajectory_id = 'a'").select(both).first()[0])["action_type_trace"] == "search > click:buy now"
    with pytest.raises(Exception, match="no purchase signature"):
        rows.where("trajectory_id = 'c'").select(both).collect()
    assert shopping.unsigned(rows.withColumn("is_success", F.lit(True))) == ["c"]


def test_run_summary(spark):
    rows = spark.createDataFrame([("r", i, i in (2, 3), False, "w", "" if i == 3 else "s") for i in range(5)], "run string, at int, is_success boolean, aborted boolean, strategy string, signature string")
    for k, want in ((2, 0), (3, 1)):
        got = shopping.run_summary(rows, ["run"], k).first()
        assert (got["success_at_k"], got["missing_signatures"], got["success_count"]) == (want, 1, 2)
    assert [tuple(r) for r in shopping.histogram(rows, ["run"]).collect()] == [("r", "w", 2)]


def test_sides_and_splits(spark):
    raw = [None, "plain", '{"content": " c ", "text": "t"}', '["a", {"content": "b"}, {"content": ""}]', '"said"', "3"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, v string").orderBy("i").select(records.side_text("v")).collect()]
    assert got == ["", "plain", "c", "a\nb", "said", "3"]
    pairs = spark.createDataFrame([("p", "c", "r", "win_lose", 1.0, 1.0)], "prompt string, chosen string, rejected string, pair_type string, target_prob double, weight double")
    assert records.one_type(pairs, "win_lose").count() == 1 and records.trainer_rows(pairs).columns == ["prompt", "chosen", "rejected"]
    for bad, kind in ((pairs.limit(0), "win_lose"), (pairs, "win_win"), (pairs.withColumn("target_prob", F.lit(0.5)), "win_lose")):
        with pytest.raises(Exception, match="no win|rule broken"):
            records.one_type(bad, kind).collect()
    rows = spark.createDataFrame([("t1", True)], "task_slug string, trajectory_success boolean")
    assert records.check_supervised(rows, rows).count() == 1
    with pytest.raises(ValueError, match="t2"):
        records.of_tasks(rows, spark.createDataFrame([("t2",)], "task_slug string"))
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-120",), ("final",)], "name string")
    assert records.newest(names).first()[0] == "checkpoint-120" and records.threshold_slug(0.9) == "0p9" and records.threshold_slug(1.0) == "1"
    assert records.steps_per_epoch(10, 4, 2) == 2 and records.steps_per_epoch(0, 4) == 1


def test_smoke_bases_and_masks(spark):
    bases = spark.createDataFrame([("t", "a", 1, True), ("t", "b", 3, True), ("u", "c", 1, True), ("u", "d", 9, False)], "task_slug string, trajectory_id string, n_steps int, is_success boolean")
    assert {r["trajectory_id"] for r in planning.bases_to_branch(bases, True, True).collect()} == {"b", "c"}
    got = spark.range(1).select(trace_rows.loss_start(F.lit("p Action: no. Action: yes"), F.lit("p "), True).alias("s"), trace_rows.loss_mask(F.array(F.lit(2), F.lit(9)), F.lit(2)).alias("m")).first()
    assert got["s"] == "p Action: no. Action: yes".rfind("Action:") and got["m"] == [0, 1]
    with pytest.raises(Exception, match="no action mark"):
        spark.range(1).select(trace_rows.loss_start(F.lit("Action: p none"), F.lit("Action: p "), True)).collect()
