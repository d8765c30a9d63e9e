"""Notices, failures, actions and bases on small rows."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import bases, calls


def test_notice(spark):
    rows = spark.createDataFrame([("a b\nc",), ("",), (None,), ("Observation:\nx",)], "t string")
    got = rows.select("t", calls.split_notice(calls.with_notice(F.col("t"), F.lit("go"))).alias("p"), calls.split_notice(F.col("t")).alias("q")).collect()
    assert [r.p.clean for r in got] == [r.t or "" for r in got]
    assert all(r.p.notice.endswith("action: go\n\nObservation:") and not r.q.notice and not r.q.clean for r in got)


def test_scored_text(spark):
    rows = spark.createDataFrame([("Thought: Action: x\nAction: go ",)], "t string")
    assert rows.select(calls.scored_text(F.col("t"), True)).first()[0] == "Action: go"
    with pytest.raises(Exception, match="no action mark"):
        rows.select(calls.scored_text(F.lit("go"), True)).collect()
    with pytest.raises(Exception, match="empty response"):
        rows.select(calls.scored_text(F.lit(" "))).collect()


def test_actions(spark):
    row = spark.range(1).select(
        calls.action_space(F.lit("other"), F.lit("Available commands (choose exactly one as your final Action):\n- a\n- b\n\nx")).alias("space"),
        calls.without(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit(" b "))).alias("left"),
        calls.taken(F.lit(None).cast("string"), F.array(F.lit("a")), F.lit("a")).alias("taken"),
        calls.task_id("babyai", F.lit("goto")).alias("full"),
        calls.task_id("babyai", F.lit("own")).alias("own"),
    )
    got = row.first()
    assert (got.space, got.left, tuple(got.taken), got.full, got.own) == (["a", "b"], ["a", "a"], ("a", True), "BabyAI-MixedTrainLocal-v0/goto", "own")


def test_bases(spark):
    runs = spark.createDataFrame([("e1", "t1", True, ["a", " "]), ("e2", "t2", False, None)], "trajectory_id string, task_slug string, is_success boolean, actions array<string>")
    assert tuple(bases.counts(runs).first()) == (2, 1, 1)
    with pytest.raises(ValueError, match="e1"):
        bases.pooled({"x": runs, "y": runs})
    with pytest.raises(ValueError, match="no runs"):
        bases.pooled({})
    assert bases.nothing(spark, runs).count() == 0
    files = spark.createDataFrame([(p,) for p in ("/r/a/x_summary.json", "/r/results.json", "/r/b/stage_manifest.json", "/r/summary.json", "/q/summary.json", "/r/a/results.json")], "path string")
    assert [r.path for r in bases.summary_files(files, "/r").collect()] == ["/r/summary.json", "/r/results.json", "/r/a/results.json", "/r/a/x_summary.json"]
    traces = spark.createDataFrame([("e1", "/b"), ("e1", "/a")], "episode_id string, trace_path string")
    found = bases.with_trace(runs.withColumnRenamed("trajectory_id", "episode_id"), traces)
    assert {r.episode_id: r.trace_path for r in found.collect()} == {"e1": "/a", "e2": None}
    with pytest.raises(ValueError, match="no pairs"):
        bases.training_records(runs, None, "other")


def test_thought():
    from tracewright.functions.python_text import thought_alone

    assert [thought_alone(x) for x in (None, " ", "THOUGHT : a\nb", "just this\nnot that", "Thought: x\nAction: go")] == ["", "", "a\nb", "just this", "x"]


def test_resume_request():
    from tracewright.operators.resume import check_request

    check_request({"a": 1, "resume": True, "num_workers": 2}, {"a": 1})
    with pytest.raises(ValueError, match="a, b"):
        check_request({"a": 1, "b": None}, {"a": 2})


def test_shuffled(spark):
    from tracewright.operators.sft import shuffled

    rows = spark.range(200)
    one, again, other = ([r.id for r in shuffled(rows.repartition(n), ["id"], "s", e).collect()] for n, e in ((3, 0), (7, 0), (3, 1)))
    assert one == again != other and sorted(one) == sorted(other) == list(range(200))


def test_signed(spark):
    from tracewright.operators.shopping import signed

    rows = spark.createDataFrame([("a", True, ""), ("b", False, ""), ("c", True, "x")], "trajectory_id string, is_success boolean, signature string")
    with pytest.raises(ValueError, match="1 successes without a purchase signature: a"):
        signed(rows)
    assert signed(rows.where("signature <> ''")).count() == 1


def test_ways(spark):
    from tracewright.operators.diversity import ways

    rows = spark.createDataFrame([("t", 0, "up", "turn left"), ("t", 1, "up", "turn right")], "trajectory_id string, step int, action string, turn_action string")
    assert ways(rows, "none").first().actions == ["up", "up"]
    assert ways(rows).count() == 1
    for rule in ("babaisai_noop_loop_prune", "other"):
        with pytest.raises(ValueError, match=rule):
            ways(rows, rule)
