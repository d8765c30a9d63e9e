"""Trainers' files: each rule by a line that breaks it, and what sound files give."""

import json

import pytest

from tracewright.sources import strict_lines, training_files

SIDE = {"action_text": "go", "success": True}
PAIR = {"pair_type": "win_lose", "prompt": "p", "chosen": SIDE, "rejected": SIDE | {"action_text": "stop"}}
BALANCED = PAIR | {"pair_weight": "2", "chosen_target_prob": 0.75}
SFT = {"prompt": [{"role": "user", "content": " a "}], "completion": [{"role": "assistant", "content": "b"}]}


def without(d, *keys):
    return {k: v for k, v in d.items() if k not in keys}


BAD = {
    "pair": {
        "missing required fields: pair_type, chosen": without(PAIR, "pair_type", "chosen"), "prompt must be a text that isn't empty": PAIR | {"prompt": " "}, "chosen must be an object": PAIR | {"chosen": "go"},
        "rejected: missing required fields: success": PAIR | {"rejected": {"action_text": "x"}}, "chosen.action_text must be a text that isn't empty": PAIR | {"chosen": SIDE | {"action_text": 5}},
        "chosen_target_prob must be in [0, 1]": PAIR | {"chosen_target_prob": 1.5}, "pair_type tie is not win_lose or win_win": PAIR | {"pair_type": "tie"}, "row must be an object": [1],
    },
    "balanced_pair": {"missing required fields: pair_weight": without(BALANCED, "pair_weight"), "pair_weight must be above 0": BALANCED | {"pair_weight": 0}, "chosen_target_prob must be in [0, 1]": BALANCED | {"chosen_target_prob": "much"}},
    "sft": {
        "missing required fields: completion": without(SFT, "completion"), "prompt must be a list that isn't empty": SFT | {"prompt": []}, "prompt[2] must be an object": SFT | {"prompt": [*SFT["prompt"], "x"]},
        "completion[1] must contain a role and a content": SFT | {"completion": [{"role": "assistant", "content": " "}]}, "completion[1] must have one of the roles assistant": SFT | {"completion": SFT["prompt"]},
    },
}
GOOD = {"pair": [PAIR, PAIR | {"chosen_target_prob": "0.5", "pair_type": "win_win"}], "balanced_pair": [BALANCED], "sft": [SFT]}


@pytest.mark.parametrize("kind", training_files.KINDS)
def test_every_rule(spark, tmp_path, kind):
    lines = [""] + [json.dumps(x) for x in GOOD[kind]] + [json.dumps(x) for x in BAD[kind].values()] + ["{broken"]
    path = tmp_path / f"{kind}.jsonl"
    path.write_text("\n".join(lines) + "\n")
    got = {r["line"]: r["reason"] for r in training_files.faults(spark, str(path), kind).collect()}
    first = len(GOOD[kind]) + 2
    assert {k: v for k, v in got.items() if k < len(lines)} == {first + i: why for i, why in enumerate(BAD[kind])}
    assert got[len(lines)].startswith("invalid JSON") and len(got) == len(BAD[kind]) + 1
    with pytest.raises(ValueError, match=rf"{kind}\.jsonl:{first} "):
        training_files.read(spark, str(path), kind)


def test_what_trainers_get(spark, tmp_path):
    for kind, rows in GOOD.items():
        (tmp_path / f"{kind}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    pairs = training_files.read(spark, str(tmp_path / "pair.jsonl"), "pair").collect()
    assert [(r["prompt"], r["chosen"], r["rejected"], r["pair_type"], r["target_prob"], r["weight"]) for r in pairs] == [("p", "go", "stop", "win_lose", 1.0, None), ("p", "go", "stop", "win_win", 0.5, None)]
    assert tuple(training_files.read(spark, str(tmp_path / "balanced_pair.jsonl"), "balanced_pair").first())[4:] == (0.75, 2.0)
    (r,) = training_files.read(spark, str(tmp_path / "sft.jsonl"), "sft").collect()
    assert [tuple(m) for m in r["prompt"]] == [("user", "a")] and [tuple(m) for m in r["completion"]] == [("assistant", "b")]
    with pytest.raises(ValueError, match=r"pair\.jsonl:2 pair_type win_win is not win_lose"):
        training_files.read(spark, str(tmp_path / "pair.jsonl"), "pair", "win_lose")
    (tmp_path / "none.jsonl").write_text("\n\n")
    with pytest.raises(ValueError, match="no rows"):
        training_files.read(spark, str(tmp_path / "none.jsonl"), "pair")


def test_numbers_of_lines_over_ranges(spark, tmp_path):
    lines = [f'{{"i": {i}}}' + " " * (i % 50) if i % 9 else "" for i in range(3_000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {r["line"]: r["text"] for r in strict_lines.numbered(spark, str(tmp_path / "a.jsonl")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: x.strip() for k, x in enumerate(lines, 1) if x.strip()}
