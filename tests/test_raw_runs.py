"""Raw traces and their logs as typed trajectories, against plain Python, over values of every loose kind."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import raw_runs

LOOSE = [None, 0, 1, 0.5, 2, "", "x", "1", "0.25", True, False, [], {}]


def number(x):
    try:
        return None if x is None else float(x)
    except (TypeError, ValueError):
        return None


def whole(x, default):
    try:
        return default if x is None else int(x)
    except (TypeError, ValueError):
        return default


def plain(trace, log, stem, path):
    if not isinstance(trace.get("calls"), list):
        return None
    calls = trace["calls"]
    own = [c for c in calls if isinstance(c, dict)]
    wins = [log.get("success"), log.get("won"), trace.get("won")]
    said = next((bool(x) for x in wins if x is not None), None)
    won = said if said is not None else (number(log.get("progression")) or 0) >= 1 or any(c.get("won") for c in own)
    scores = [number(log.get(k)) for k in ("score", "progression", "episode_return", "reward")] + [number(c.get(k)) for c in reversed(own) for k in ("progression", "reward")]
    steps = [
        (whole(c.get("episode_step"), i), str(c.get("observation") or c.get("observation_pre") or ""), str(c.get("action") or c.get("action_executed") or c.get("action_model") or ""), None if c.get("raw_output") is None else str(c["raw_output"]), number(c.get("reward")), bool(c.get("done") or c.get("terminated")))
        for i, c in enumerate(calls) if isinstance(c, dict)
    ]
    task = str(trace.get("task_or_env_params") or log.get("task") or "given")
    return (task, str(trace.get("episode_id") or stem), str(trace.get("model_id") or "m"), whole(trace.get("seed"), 5), bool(won), next((s for s in scores if s is not None), None), steps)


def loose(rng, names, drop=0.4):
    return {n: rng.choice(LOOSE) for n in names if rng.random() > drop}


def scalars(x):
    """Values whose text is the same in JSON and Python."""
    return {k: (v if not isinstance(v, (list, dict, float)) else "t") for k, v in x.items()}


def test_fields_fall_back_as_in_plain_python(spark):
    rng, traces, logs, want = random.Random(4), [], [], {}
    for i in range(150):
        calls = [
            rng.choice([5, "no call", None]) if rng.random() < 0.1
            else scalars(loose(rng, ["observation", "observation_pre", "action", "action_executed", "action_model", "raw_output"])) | loose(rng, ["episode_step", "reward", "progression", "done", "terminated", "won"])
            for _ in range(rng.randrange(5))
        ]
        trace = scalars(loose(rng, ["task_or_env_params", "episode_id", "model_id"])) | loose(rng, ["seed", "won"]) | ({"calls": rng.choice([calls, calls, calls, None, {"a": 1}])} if rng.random() < 0.95 else {})
        log = scalars(loose(rng, ["task"])) | loose(rng, ["success", "won", "progression", "score", "episode_return", "reward"], 0.7)
        stem, has_log = f"e{i}", rng.random() < 0.7
        traces.append((f"/r/x/{stem}_llm_trace.json", "/r/x", stem, json.dumps(trace)))
        if has_log:
            logs.append((f"/r/x/{stem}.json", "/r/x", stem, json.dumps(log)))
        want[i] = plain(trace, log if has_log else {}, stem, traces[-1][0])
    schema = "path string, folder string, stem string, text string"
    rows = raw_runs.normalised(spark.createDataFrame(traces, schema), spark.createDataFrame(logs, schema), "b", "given", "m", 5, root="/r").collect()
    got = {}
    for r in rows:
        meta = json.loads(r["metadata"])
        i = int(meta["trace_path"].removeprefix("x/e").removesuffix("_llm_trace.json"))
        assert meta["csv_path"] == f"x/e{i}.csv" and meta["source"] == "native_raw_trace" and (meta["episode_path"] is None) == (f"e{i}" not in {x[2] for x in logs})
        got[i] = (r["task_id"], r["trajectory_id"], r["model_id"], r["seed"], r["won"], r["score"], [tuple(s)[:6] for s in r["steps"]])
    assert got == {i: w for i, w in want.items() if w}


def test_collected_wins(spark):
    rng, rows, want = random.Random(8), [], []
    for i in range(200):
        call = loose(rng, ["won", "progression", "reward", "done"], 0.3)
        trace, log = {"calls": [{}, call] if rng.random() < 0.9 else []}, loose(rng, ["progression", "episode_return", "done"], 0.6)
        last = trace["calls"][-1] if trace["calls"] else {}
        as_float = lambda x: number(x) or 0.0
        done = bool(log.get("done", last.get("done", False)))
        want.append(bool(last.get("won", False)) or as_float(log.get("progression", last.get("progression"))) >= 1 or (done and as_float(log.get("episode_return", last.get("reward"))) > 0))
        rows.append((i, json.dumps(trace), json.dumps(log)))
    frame = spark.createDataFrame(rows, "i int, t string, l string").select("i", raw_runs.collected_win(F.parse_json("t"), F.parse_json("l")).alias("w"))
    assert [r["w"] for r in frame.orderBy("i").collect()] == want


def test_base_source(spark, tmp_path):
    run = tmp_path / "run"
    os.makedirs(run / "a" / "_dtc_x")
    call = {"action": "go", "reward": 1, "won": True}
    (run / "a" / "one_llm_trace.json").write_text(json.dumps({"calls": [call], "seed": "3"}))
    (run / "a" / "one.json").write_text(json.dumps({"task": "t", "progression": 0.5}))
    (run / "a" / "two_llm_trace.json").write_text(json.dumps({"calls": "none"}))
    (run / "a" / "b__dtc_d01_a00_llm_trace.json").write_text(json.dumps({"calls": [call]}))
    (run / "a" / "_dtc_x" / "c_llm_trace.json").write_text(json.dumps({"calls": [call]}))
    rows = raw_runs.base_source(spark, f"file://{run}", "bench", into=f"file://{tmp_path}/out").collect()
    assert [(r["trajectory_id"], r["task_id"], r["seed"], r["won"], r["score"]) for r in rows] == [("one", "t", 3, True, 0.5)]
    said = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert (said["num_trajectories"], said["num_success"], said["rows"]) == (1, 1, 1)
    with pytest.raises(ValueError, match="1 trajectories, 2 expected"):
        raw_runs.checked(raw_runs.base_source(spark, f"file://{run}", "bench"), 2)
    (run / "a" / "three_llm_trace.json").write_text("[1]")
    with pytest.raises(Exception, match="trace is no JSON object"):
        raw_runs.base_source(spark, f"file://{run}", "bench").collect()
    (run / "trajectories.jsonl").write_text(json.dumps({"benchmark": "b", "task_id": "t", "trajectory_id": "x", "model_id": "m", "seed": 1, "won": True}))
    assert [r["trajectory_id"] for r in raw_runs.base_source(spark, f"file://{run}", "bench").collect()] == ["x"]
