"""Typed artifacts: coercions as plain Python has them, quarantine, and round trips."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import variants as V
from tracewright.sources import artifacts

VALUES = ["1", "0", "-7", "1.9", "-2.5", "1e3", "true", "false", "null", '""', '"0"', '" 7 "', '"7.0"', '"x"', '"nan"', "[]", "[0]", "{}", '{"a": 0}', "12345678901234567"]


def plain(f, raw):
    try:
        return f(json.loads(raw))
    except (TypeError, ValueError, OverflowError):
        return None


def test_coercions_are_pythons(spark):
    rows = spark.createDataFrame([(x,) for x in VALUES], "t string").withColumn("v", F.parse_json("t"))
    got = {r["t"]: r for r in rows.select("t", V.whole(F.col("v")).alias("i"), V.number(F.col("v")).alias("x"), V.truth(F.col("v")).alias("b"), V.text(F.col("v")).alias("s")).collect()}
    for raw in VALUES:
        assert got[raw]["i"] == plain(int, raw), raw
        assert str(got[raw]["x"]) == str(plain(float, raw)), raw
        assert got[raw]["b"] == bool(json.loads(raw)), raw
        if not isinstance(json.loads(raw), (float, list, dict)):
            assert got[raw]["s"] == str(json.loads(raw)), raw


def metric_by_hand(payload, keys):
    def number(x):
        try:
            return None if x is None else float(x)
        except (TypeError, ValueError):
            return None

    for k in keys:
        if (x := number(payload.get(k))) is not None:
            return x
    if isinstance(nested := payload.get("metrics"), dict):
        for k in keys:
            x = nested.get(k)
            if (x := number(x.get("mean") or x.get("value") if isinstance(x, dict) else x)) is not None:
                return x
    won, of = number(payload.get("success_count") or payload.get("num_success")), number(payload.get("episode_count") or payload.get("num_episodes") or payload.get("total"))
    return won / of if won is not None and of else None


def test_metric_chain(spark):
    payloads = [
        {"success_rate": "0.5"}, {"success_rate": None, "rate": 40}, {"metrics": {"rate": {"mean": 0, "value": 0.3}}}, {"metrics": {"success_rate": "x", "rate": 2}}, {"metrics": 5, "success_count": 3, "total": 4},
        {"success_count": 0, "num_success": 2, "episode_count": 0, "num_episodes": "8"}, {"success_count": 1, "episode_count": 0}, {}, {"metrics": {"success_rate": {"mean": "0.25"}}}, {"success_rate": {"mean": 1}}, {"rate": True},
    ]
    rows = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)], "i int, t string").withColumn("v", F.parse_json("t"))
    got = {r["i"]: r["m"] for r in rows.select("i", V.metric(F.col("v"), ["success_rate", "rate"]).alias("m")).collect()}
    assert got == {i: metric_by_hand(p, ["success_rate", "rate"]) for i, p in enumerate(payloads)}
    shares = {r["i"]: r["m"] for r in rows.select("i", V.share(V.metric(F.col("v"), ["rate"])).alias("m")).collect()}
    assert shares[1] == 0.4 and shares[3] == 0.02 and shares[10] == 1.0


TRAJECTORY = {"benchmark": "b", "task_id": 4, "trajectory_id": "t", "model_id": "m", "seed": "12", "won": 1, "score": None, "steps": [{"step_index": 0, "observation": "o", "action": "a", "reward": "0.5", "metadata": {"z": 1, "a": [1, {"k": None}]}}], "metadata": {}, "more": 1}
BRANCHES = {"benchmark": "b", "task_id": "t", "collection_method": "c", "source_trajectory_id": "s", "divergence_step": 3.0, "prompt_text": "p", "branches": [{"branch_id": "x", "trajectory_id": "y", "divergence_step": 3, "action": "go", "won": False, "score": 0.5, "response_text": "r"}]}
PAIRS = {"benchmark": "b", "task_id": "t", "collection_method": "c", "dataset_method": "d", "training_method": "t", "records": [{"prompt_text": "p", "chosen_text": "c", "rejected_text": "r", "pair_type": "win_lose", "target_prob": "1.0"}, {"prompt_text": "p", "chosen_text": "c", "rejected_text": "r", "pair_type": "win_win", "target_prob": 0.5, "weight": 2, "metadata": {"k": "v"}}]}


def without(d, key):
    return {k: v for k, v in d.items() if k != key}


def test_quarantine_names_what_is_wrong(spark):
    step = TRAJECTORY["steps"][0]
    bad = {
        "seed is missing": without(TRAJECTORY, "seed"), "seed is no whole number": TRAJECTORY | {"seed": "7.5"}, "score is no number": TRAJECTORY | {"score": "high"}, "steps is no list": TRAJECTORY | {"steps": None},
        "steps[1] step_index is missing": TRAJECTORY | {"steps": [step, without(step, "step_index")]}, "steps[0] is no object": TRAJECTORY | {"steps": [5]}, "metadata is no object": TRAJECTORY | {"metadata": None},
        "steps[0] metadata is no object": TRAJECTORY | {"steps": [step | {"metadata": [1]}]},
    }
    lines = [json.dumps(x) for x in [TRAJECTORY, *bad.values(), without(TRAJECTORY, "steps")]] + ["[1]", "{", '{"benchmark": 1} x', " "]
    rows = spark.createDataFrame([(x,) for x in lines], "text string")
    good, quarantine = artifacts.typed(rows, "trajectory")
    reasons = {r["text"]: r["reason"] for r in quarantine.collect()}
    assert {k: reasons[json.dumps(x)] for k, x in bad.items()} == {k: k for k in bad}
    assert good.count() == 2 and len(reasons) == len(bad) + 3 and good.count() + quarantine.count() == len(lines) - 1
    (r,) = good.where("size(steps) = 1").collect()
    assert (r["task_id"], r["seed"], r["won"], r["score"], r["steps"][0]["reward"], r["steps"][0]["done"], r["steps"][0]["raw_model_output"]) == ("4", 12, True, None, 0.5, False, None)
    assert json.loads(r["steps"][0]["metadata"].toJson()) == step["metadata"]


@pytest.mark.parametrize(("kind", "payload"), [("trajectory", TRAJECTORY), ("branch_set", BRANCHES), ("pair_dataset", PAIRS)])
def test_round_trip(spark, tmp_path, kind, payload):
    (tmp_path / "in.jsonl").write_text(json.dumps(payload, indent=2 if kind == "pair_dataset" else None) + "\n")
    rows = artifacts.read(spark, str(tmp_path / "in.jsonl"), kind)
    (text,) = [r[0] for r in rows.select(artifacts.json_text(rows)).collect()]
    said = json.loads(text)
    assert list(said) == sorted(said) and text == json.dumps(said, sort_keys=True, separators=(",", ":"))
    (tmp_path / "out.jsonl").write_text(text)
    again = artifacts.read(spark, str(tmp_path / "out.jsonl"), kind)
    assert [r[0] for r in again.select(artifacts.json_text(again)).collect()] == [text]
    if kind == "pair_dataset":
        assert [x["weight"] for x in said["records"]] == [1.0, 2.0] and said["records"][0]["metadata"] == {}
    (tmp_path / "bad.jsonl").write_text(json.dumps(without(payload, "task_id")))
    with pytest.raises(Exception, match=f"no {kind}: task_id is missing"):
        artifacts.read(spark, str(tmp_path / "bad.jsonl"), kind).collect()


def test_first_table(spark, tmp_path):
    with pytest.raises(ValueError, match="has none of"):
        artifacts.first_table(spark, str(tmp_path))
    (tmp_path / "base_trajectories.jsonl").write_text(json.dumps(TRAJECTORY))
    assert artifacts.first_table(spark, str(tmp_path)).count() == 1
    (tmp_path / "trajectories.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no trajectories in"):
        artifacts.first_table(spark, str(tmp_path))
