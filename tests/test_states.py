"""Candidates at the states of a branch index, against the rules written out."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewright.functions import outcomes
from tracewright.operators import candidates, pairs
from tracewright.sources import traces

CALLS = {
    "b": [("o0", "up", 0.0), ("o1", "up", 0.0), ("o2", "down", 0.5)],
    "x": [("o0", "up", 0.0), ("o1", "left", 0.0), ("o3", "left", 1.0)],
    "y": [("o0", "up", 0.0), ("o1", "up", 0.0), ("o2", "right", 0.0), ("o2", "right", 1.0)],
    "z": [("o0", "up", 0.0), ("o1", "down", 0.0)],
}
INDEX = [("x", "b", 1, "s1", "generated", True), ("y", "b", 2, "s2", "generated", True), ("z", "b", 1, "s1b", "generated", True), ("z", "b", 0, "s0", "failed", True), ("q", "gone", 0, "s", "generated", True)]


def traced(spark, ids, calls=CALLS):
    rows = [{"episode_id": i, "trace_path": i, "task_or_env_params": "a/t", "seed": 3, "calls": [{"instruction": "do", "observation": o, "action": a, "progression": p} for o, a, p in calls[i]]} for i in ids]
    return spark.createDataFrame(rows, f"trace_path string, {traces.TRACE}")


def built(spark, index=INDEX, calls=CALLS):
    branches = spark.createDataFrame([(*x, x[0]) for x in index], "alt_traj_id string, base_traj_id string, divergence_step int, state_key string, status string, replay_success boolean, output_trace string")
    return candidates.at_states(branches, traced(spark, "b", calls), traced(spark, "xyz", calls), outcomes.by_progression(F.col("terminal_progression")))


def test_each_state_has_its_own_step_key_and_length(spark):
    rows = built(spark).collect()
    got = {(r["divergence_step"], r["state_key"], r["trajectory_id"], r["action_text"], r["post_divergence_call_count"], r["quality_score"], r["is_win"]) for r in rows}
    assert len(rows) == len(got) and got == {
        (1, "s1", "b", "up", 2, 1, False), (1, "s1", "x", "left", 2, 1, True), (2, "s2", "b", "down", 1, 1, False),
        (2, "s2", "y", "right", 2, 2, True), (1, "s1b", "b", "up", 2, 1, False), (1, "s1b", "z", "down", 1, 1, False),
    }
    assert all(r["prompt"][1]["content"].startswith(f"Current Observation:\no{r['divergence_step']}\n") for r in rows)


def test_wins_and_losses_of_different_states_do_not_meet(spark):
    rows = built(spark)
    found = pairs.win_lose(pairs.good_wins(rows, 1), rows.where("not is_win")).select("state_key", "chosen.trajectory_id", "rejected.trajectory_id").collect()
    assert [tuple(r) for r in found] == [("s1", "x", "b")]


@pytest.mark.parametrize(
    ("index", "calls", "says"),
    [
        ([("z", "b", 2, "s", "generated", True)], CALLS, "out of range for z"),
        ([("x", "b", 3, "s", "generated", True)], CALLS, "out of range for b"),
        ([("x", "b", 1, "s", "generated", True)], CALLS | {"b": [("o0", "up", 0.0), ("", "up", 0.0)]}, "no prompt at divergence step of b"),
        ([("x", "b", 1, "s", "generated", True)], CALLS | {"x": [("o0", "up", 0.0), ("o1", "", 0.0)]}, "no response at divergence step of x"),
    ],
)
def test_unsound_states_are_errors(spark, index, calls, says):
    with pytest.raises(PySparkException, match=says):
        built(spark, index, calls).collect()
