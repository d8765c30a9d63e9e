"""Conversations and trajectories longer than any bound, against Python."""

import hashlib
import json
from collections import defaultdict

from tracewright.operators import sft
from tracewright.queries import QUERIES
from tracewright.sources import event_view

DATA = "/root/testdata/sf0.001"


def test_state_keys_take_all_actions_before_each_step(spark):
    actions, about = defaultdict(dict), {}
    for r in event_view.steps(spark, DATA).collect():
        actions[r["trajectory_id"]][r["step"]] = r["action"]
        about[r["trajectory_id"]] = (r["task_slug"], r["week"])
    got = QUERIES["state_key"](spark, DATA).collect()
    for r in got:
        t = r["trajectory_id"]
        before = [actions[t][i] for i in range(r["divergence_step"])]
        task, seed = about[t]
        assert r["state_key"] == hashlib.sha1("\n<SEP>\n".join((task, str(seed), json.dumps(before))).encode()).hexdigest()
    assert {r["trajectory_id"] for r in got} == {t for t, a in actions.items() if len(a) > 1}
    assert max(r["divergence_step"] for r in got) > 3


def talk(spark, n):
    return spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(n)], "conv_id long, turn int, role string, text string")


def test_prompts_are_the_whole_conversation(spark):
    rows = {r["turn"]: [m["content"] for m in r["prompt"]] for r in sft.rows_from_turns(talk(spark, 40)).collect()}
    assert rows == {i: [f"t{k}" for k in range(i)] for i in range(1, 40, 2)}
    cut = {r["turn"]: [m["content"] for m in r["prompt"]] for r in sft.rows_from_turns(talk(spark, 40), most=4).collect()}
    assert cut[39] == ["t35", "t36", "t37", "t38"]


def test_default_history_has_sixteen_turns(spark, tmp_path):
    talk(spark, 40).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: r["history_sha256"] for r in QUERIES["history_window_default"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256("\n".join(f"t{k}" for k in range(max(0, i - 15), i + 1)).encode()).hexdigest() for i in range(40)}
