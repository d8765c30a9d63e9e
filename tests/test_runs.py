"""Prompts, epochs, sinks, ledgers in buckets, kept scores, statistics and reports, against plain Python."""

import itertools
import json
import math
import os
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tracewright.operators import branching, checks, diversity, epochs, prompts, reports, sft, sliding, statistics
from tracewright.plans.scoring import known, scored_once
from tracewright.sources import commits
from tracewright.streaming import buckets

# -- prompts


def prompt_by_hand(events, instruction, texts, reasonings):
    """The prompt after the last event, from a bounded queue of events."""
    held = list(deque(events, maxlen=2 * max(texts, 1)))
    found = [("user", instruction)] if instruction else []
    seen = [i for i, e in enumerate(held) if e["seen"]]
    thought = [i for i, e in enumerate(held) if not e["seen"] and e["reasoning"] is not None]
    thought = thought[-reasonings:] if reasonings else []
    for i in seen[-texts:] if texts else []:
        if i and not held[i - 1]["seen"]:
            before = held[i - 1]
            found.append(("assistant", f"Previous plan:\n{before['reasoning']}" if i - 1 in thought else before["said"]))
        last = i == seen[-1]
        parts = ["Current Observation:" if last else "Observation:", *([held[i]["now"]] if last and held[i]["now"] else []), held[i]["said"]]
        found.append(("user", "\n".join(parts)))
    return found


@pytest.mark.parametrize(("texts", "reasonings", "block"), [(16, 1, 8_192), (3, 2, 24), (1, 0, 8), (2, 5, 16), (0, 1, 8)])
def test_prompts_are_those_of_a_bounded_queue(spark, texts, reasonings, block):
    rng = random.Random(texts)
    seen, done, by_group = [], [], defaultdict(list)
    for g, n in (("hot", 150), ("b", 9), ("c", 1), (None, 5)):
        for t in range(n):
            if rng.random() < 0.9:
                now = rng.choice([None, "", f"now {t}"])
                seen.append((g, t, f"o{t}", now))
                by_group[g].append({"seen": True, "step": t, "said": f"o{t}", "now": now, "reasoning": None})
            if rng.random() < 0.8:
                why = rng.choice([None, f"r{t}"])
                done.append((g, t, f"a{t}", why))
                by_group[g].append({"seen": False, "step": t, "said": f"a{t}", "now": None, "reasoning": why})
    woven = prompts.woven(spark.createDataFrame(seen, "g string, t int, said string, now string"), spark.createDataFrame(done, "g string, t int, said string, reasoning string"), "g", "t")
    got = {(r["g"], r["t"]): [tuple(m) for m in r["messages"]] for r in prompts.prompts(woven, F.when(F.col("g") == "hot", "do"), "g", "t", texts, reasonings, block).collect()}
    want = {}
    for g, events in by_group.items():
        for i, e in enumerate(events):
            if e["seen"]:
                want[g, e["step"]] = prompt_by_hand(events[: i + 1], "do" if g == "hot" else None, texts, reasonings)
    assert got == want


def test_windows_cross_blocks_but_not_groups(spark):
    rows = [("a", i) for i in range(100)] + [("b", i) for i in range(3)] + [(None, i) for i in range(7)]
    frame = spark.createDataFrame(rows, "g string, i int").repartition(5)
    got = {(r["g"], r["i"]): [x["i"] for x in r["recent"]] for r in sliding.windows(frame, "g", ["i"], 5, ["i"], block=1).collect()}
    assert got == {(g, i): list(range(max(0, i - 4), i + 1)) for g, i in rows}


# -- epochs


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 97, 1000, 10_007])
def test_an_epoch_has_each_index_once(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "i")
    orders = [[r["place"] for r in epochs.epoch_order(rows, n, 7, e).orderBy("i").collect()] for e in (0, 1)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 12 or orders[0] != orders[1]
    assert orders[0] == [r["place"] for r in epochs.epoch_order(rows, n, 7, 0).orderBy("i").collect()]


def test_orders_look_random_and_leave_few_places_over():
    assert all(a * b >= n and a * b - n < 64 for n in (10, 999, 10**6 + 3, 10**9 + 7, 10**12 + 39) for a, b in [epochs.shape(n)])


def test_balanced_epochs_need_no_sort(spark):
    a, b = spark.range(40).withColumnRenamed("id", "i"), spark.range(7).withColumnRenamed("id", "i")
    found = epochs.balanced_epoch(a, b, (40, 7), 3, 0)
    rows = found.collect()
    assert sorted(r["place"] for r in rows) == list(range(40)) and sorted(r["a_i"] for r in rows) == list(range(40))
    at = {r["place"]: r["b_i"] for r in rows}
    assert sorted(at[p] for p in range(7)) == list(range(7)) and all(at[p] == at[p % 7] for p in at)
    assert "Sort [" not in found._jdf.queryExecution().executedPlan().toString() and "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows != epochs.balanced_epoch(a, b, (40, 7), 3, 1).collect()
    with pytest.raises(ValueError, match="need rows"):
        epochs.balanced_epoch(a, b, (40, 0), 3, 0)


# -- ranks and balancing


def test_ranks_leave_nothing_cached_and_ties_are_in_order(spark):
    rows = spark.createDataFrame([(i % 3, f"v{i}") for i in range(50)], "k int, v string").repartition(7)
    one = {r["v"]: r["rank"] for r in branching.ranked(rows, "k")[0].collect()}
    assert one == {r["v"]: r["rank"] for r in branching.ranked(rows.repartition(2), "k", parts=9)[0].collect()} and sorted(one.values()) == list(range(50))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


@pytest.mark.parametrize(("few", "most"), [(10_000, 1_000_000), (1, 5)])
def test_rebalanced_by_any_way(spark, monkeypatch, few, most):
    monkeypatch.setattr(sft, "FEW_GROUPS", few)
    monkeypatch.setattr(sft, "MOST_IN_TASK", most)
    sizes = {"a": 1, "b": 30, "c": 7, "d": 2}
    rows = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)] + [(None, 1)], "g string, i int").repartition(3)
    got = defaultdict(dict)
    for r in sft.rebalanced(rows, "g", "i").collect():
        got[r["g"]][r["place"]] = r["i"]
    for k, (g, n) in enumerate(sizes.items()):
        t = 10
        want = [p % n if t >= n else min(n - 1, math.floor((2 * p + 1) * n / (2 * t))) for p in range(t)]
        assert [got[g][p] for p in range(len(got[g]))] == want, (k, g)
    assert sft.rebalanced(rows.limit(0), "g", "i").count() == 0


# -- sinks


def test_a_commit_is_all_or_nothing(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(i, f"g{i % 3}", {"z": 1, "a": None}) for i in range(20)], "b int, a string, m map<string,int>").repartition(4)
    said = commits.commit(rows, target, {"stage": "build"}, by=["a"])
    text = open(f"{tmp_path}/out/manifest.json").read()
    assert text == json.dumps(json.loads(text), indent=2, sort_keys=True) + "\n" and json.loads(text) == said and said["rows"] == 20 and said["stage"] == "build"
    lines = [x for d, _, names in os.walk(f"{tmp_path}/out/rows") for n in names if n.startswith("part") for x in open(f"{d}/{n}").read().splitlines()]
    assert sorted(lines) == sorted(f'{{"b":{i},"m":{{"a":null,"z":1}}}}' for i in range(20))
    assert commits.committed_rows(spark, target, "b int, a string", check=True).count() == 20
    with pytest.raises(FileExistsError):
        commits.commit(rows, target)

    @F.udf("int")
    def fails(x):
        if x == 13:
            raise RuntimeError("killed midway")
        return x

    for name in (target, f"file://{tmp_path}/other"):
        with pytest.raises(Exception, match="killed midway"):
            commits.commit(rows.withColumn("b", fails("b")), name, overwrite=True)
    assert sorted(os.listdir(tmp_path)) == ["out"] and commits.committed_rows(spark, target, "b int", check=True).count() == 20
    assert commits.commit(rows.limit(3), target, overwrite=True)["rows"] == 3 and sorted(os.listdir(tmp_path)) == ["out"]


def test_tampered_or_unfinished_tables_are_errors(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    commits.commit(spark.range(10).coalesce(1), target)
    (part,) = [f"{tmp_path}/out/rows/{n}" for n in os.listdir(f"{tmp_path}/out/rows") if n.startswith("part")]
    content = open(part).read()
    open(part, "w").write(content.replace('"id":7', '"id":8'))
    os.remove(f"{tmp_path}/out/rows/.{os.path.basename(part)}.crc")
    with pytest.raises(ValueError, match="not as its manifest says"):
        commits.committed_rows(spark, target, "id long", check=True)
    os.remove(f"{tmp_path}/out/manifest.json")
    with pytest.raises(ValueError, match="was not committed"):
        commits.committed_rows(spark, target, "id long")


def test_stages_say_what_they_counted(spark, tmp_path):
    said = commits.run_stage("build", lambda: spark.range(9), f"file://{tmp_path}/s", {"k": 1}, {"even": F.col("id") % 2 == 0})
    assert said["counts"] == {"even": 5} and commits.read_json(spark, f"file://{tmp_path}/s/manifest.json") == said and said["seconds"] >= 0


# -- ledgers in buckets


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    rows = lambda xs: spark.createDataFrame(xs, "k int, ord int, v string")
    want, rng = {}, random.Random(3)
    for number in range(5):
        batch = [(rng.randrange(40), rng.randrange(100), f"{number}-{i}") for i in range(6)]
        before = buckets.state(spark, ledger)
        touched = buckets.upsert(spark, ledger, rows(batch), number, ["k"], buckets=16)
        after = buckets.state(spark, ledger)
        assert {int(b) for b, n in after["held"].items() if n == number} == set(touched) and len(touched) <= 6
        assert all(after["held"][b] == n for b, n in (before or {"held": {}})["held"].items() if int(b) not in touched)
        assert buckets.upsert(spark, ledger, rows([(1, 10**6, "again")]), number, ["k"]) == []  # a replay
        best = {}
        for k, o, v in batch:
            best[k] = max(best.get(k, (-1, "")), (o, v))
        for k, x in best.items():
            want[k] = max(want.get(k, (-1, "")), x)
    assert {r["k"]: r["ord"] for r in buckets.held_rows(spark, ledger).collect()} == {k: o for k, (o, _) in want.items()}
    some = rows([(k, 0, "") for k in list(want)[:3]])
    found = buckets.records_of(spark, ledger, some, ["k"])
    assert {r["k"] for r in found.collect()} == set(list(want)[:3]) and len(found.inputFiles()) <= 3
    held = {n for n in buckets.state(spark, ledger)["held"].values()}
    buckets.sweep(spark, ledger)
    assert {int(n.removeprefix("batch=")) for n in os.listdir(f"{tmp_path}/ledger/rows") if n.startswith("batch=")} == held
    assert {r["k"]: r["ord"] for r in buckets.held_rows(spark, ledger).collect()} == {k: o for k, (o, _) in want.items()}


def test_a_batch_without_a_list_is_not_seen(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], "k int, ord int, v string")
    buckets.upsert(spark, ledger, one, 0, ["k"], buckets=4)
    spark.createDataFrame([(1, 9, "lost", 0)], "k int, ord int, v string, bucket int").write.partitionBy("bucket").parquet(f"{ledger}/rows/batch=1")  # a batch that died before its list
    assert {r["v"] for r in buckets.held_rows(spark, ledger).collect()} == {"a"}
    buckets.upsert(spark, ledger, spark.createDataFrame([(1, 2, "b")], "k int, ord int, v string"), 1, ["k"])
    assert {(r["k"], r["v"]) for r in buckets.held_rows(spark, ledger).collect()} == {(1, "b"), (2, "a")}


# -- kept scores


def test_scores_are_made_once(spark, tmp_path):
    folder, seen = f"file://{tmp_path}/scores", []

    def scorer(keys):
        rows = keys.collect()
        seen.append(Counter((r["a"], r["b"]) for r in rows))
        return spark.createDataFrame([(r["a"], r["b"], float(len(r["b"] or "") + (r["a"] or 0))) for r in rows], "a int, b string, score double")

    frame = lambda xs: spark.createDataFrame(xs, "a int, b string, c int")
    first = [(1, "x", 1), (1, "x", 2), (None, "y", 3), (2, None, 4)]
    got = scored_once(frame(first), scorer, ["a", "b"], folder, "s-1").collect()
    assert {r["c"]: r["score"] for r in got} == {1: 2.0, 2: 2.0, 3: 1.0, 4: 2.0} and max(max(s.values(), default=0) for s in seen) == 1
    seen.clear()
    more = scored_once(frame([*first, (5, "new", 5)]), scorer, ["a", "b"], folder, "s-1")
    assert {r["c"]: r["score"] for r in more.collect()} == {1: 2.0, 2: 2.0, 3: 1.0, 4: 2.0, 5: 8.0} and set(seen[0]) == {(5, "new")}
    seen.clear()
    scored_once(frame(first), scorer, ["a", "b"], folder, "s-1")
    assert not any(seen) and known(spark, folder).count() == 4
    scored_once(frame(first), scorer, ["a", "b"], folder, "s-2")  # another scorer's scores are others
    assert set(seen[-1]) == {(1, "x"), (None, "y"), (2, None)}


# -- compatibility


def test_differences_are_named_by_path(spark):
    a = spark.createDataFrame([], "a int, b struct<c: string, d: array<struct<e: int, f: string>>>, m map<string, array<int>>, z string not null")
    b = spark.createDataFrame([], "a bigint, b struct<c: string, d: array<struct<e: string, g: int>>>, m map<string, array<double>>, z string, n int")
    got = {(r["path"], r["what"]): (r["left"], r["right"]) for r in checks.compatibility(a, b).collect()}
    assert got == {("a", "type"): ("int", "bigint"), ("b.d[].e", "type"): ("int", "string"), ("b.d[].f", "missing"): ("string", ""), ("b.d[].g", "added"): ("", "int"), ("m{}[]", "type"): ("int", "double"), ("z", "nullable"): ("false", "true"), ("n", "added"): ("", "int")}
    assert checks.compatibility(a, a).count() == 0 and checks.is_compatible(a, a) and not checks.is_compatible(a, b)
    assert checks.is_compatible(spark.createDataFrame([], "a int"), spark.createDataFrame([], "a int, b int"))


# -- loops


def loops_by_hand(rows):
    stack, removed = [], 0
    for a, pre, post, fixed in rows:
        if pre == post and not fixed:
            removed += 1
        elif stack and diversity.INVERSE.get(stack[-1][0]) == a and stack[-1][1] and stack[-1][1] == post and not stack[-1][3] and not fixed:
            stack.pop()
            removed += 2
        else:
            stack.append((a, pre, post, fixed))
    return [x[0] for x in stack], removed


def test_loops_of_a_long_trajectory_take_linear_time(spark):
    n = 100_000  # there and back: the stack holds half of all steps
    half = [("up", str(i), str(i + 1)) for i in range(n // 2)]
    steps = half + [("down", post, pre) for _, pre, post in reversed(half)]
    rows = [("long", i, a, pre, post, i == 49_999) for i, (a, pre, post) in enumerate(steps)]
    rng = random.Random(1)
    for t in range(20):
        at = 0
        for i in range(30):
            a = rng.choice(["up", "down", "left", "idle"])
            to = at + {"up": 1, "down": -1}.get(a, 0)
            rows.append((f"t{t}", i, a, str(at), str(to), rng.random() < 0.1))
            at = to
    frame = spark.createDataFrame(rows, "trajectory_id string, step int, action string, obs_pre string, obs_post string, final boolean").repartition(6)
    got = {r["trajectory_id"]: (r["actions"], r["removed"]) for r in diversity.prune_loops(frame).collect()}
    by = defaultdict(list)
    for t, _, a, pre, post, fixed in rows:
        by[t].append((a, pre, post, fixed))
    assert got == {t: loops_by_hand(x) for t, x in by.items()} and len(got["long"][0]) == 100_000


# -- statistics


@pytest.mark.parametrize("usable", ["base-alt", "base-alt-alt"])
def test_counters_are_those_of_the_pairs(spark, usable):
    rng = random.Random(9)
    rows = []
    for s in range(60):
        task = f"t{s % 3}"
        for k in range(rng.randrange(1, 7)):
            kind = "base" if k == 0 else "alt"
            rows.append((f"f{s // 2}", s % 2, f"k{s}", f"f{s // 2}" if k == 0 else f"a{rng.randrange(80)}-{s}-{k}", kind, task, rng.choice(["x", "y"]), rng.random() < 0.6, rng.randrange(1, 4), rng.randrange(1, 5)))
    frame = spark.createDataFrame(rows, "family_id string, divergence_step int, state_key string, trajectory_id string, trajectory_kind string, task_slug string, action_text string, is_win boolean, quality_score int, post_divergence_call_count int")
    ok = lambda a, b: (a[4] == "base") != (b[4] == "base") or (usable == "base-alt-alt" and a[4] == b[4] == "alt")
    want, ids = defaultdict(Counter), defaultdict(lambda: defaultdict(set))
    for _, group in itertools.groupby(sorted(rows, key=lambda r: r[:3]), key=lambda r: r[:3]):
        group = list(group)
        good = [r for r in group if r[7] and r[8] <= 2]
        lost = [r for r in group if not r[7]]
        wl = [(w, x) for w in good for x in lost if ok(w, x)]
        sup = [w for w in good if any(ok(w, x) for x in lost)]
        ww, every = [p for p in itertools.combinations(sup, 2) if ok(*p)], [p for p in itertools.combinations(good, 2) if ok(*p)]
        base = next((r for r in good if r[4] == "base"), None)
        ps = [(a, base) if a[9] < base[9] else (base, a) for a in good if base and a[4] == "alt"]
        for t in (group[0][5], None):
            c, u = want[t], ids[t]
            c.update(state_group_count=1, raw_win_candidates=sum(r[7] for r in group), quality_filtered_win_candidates=len(good), support_filtered_win_candidates=len(sup), lose_candidates=len(lost), win_lose_rows=len(wl) + len(ps), observed_win_lose_rows=len(wl), pseudo_win_lose_rows=len(ps), win_win_rows=len(ww))
            c.update(b_win_win_rows=len(every), b_win_win_eligible_wins=len(good) if every else 0, b_win_lose_state_count=bool(wl), b_win_win_state_count=bool(every), b_positive_state_count=bool(good))
            u["unique_win_trajectory_count"] |= {w[3] for w, _ in wl} | {x[3] for p in ps for x in p} | {x[3] for p in ww for x in p}
            u["unique_lose_trajectory_count"] |= {x[3] for _, x in wl}
            u["unique_rejected_trajectory_count"] |= {x[3] for _, x in wl} | {x[3] for _, x in ps}
            u["b_unique_positive_trajectory_count"] |= {w[3] for w in good}
    found = statistics.filtered_statistics(frame, 2, usable, pseudo=True)
    for r in found.collect():
        t = r["task_slug"]
        assert {k: v for k, v in r.asDict().items() if k != "task_slug"} == {k: v for k, v in want[t].items() if not k.startswith("b_")} | {k: len(v) for k, v in ids[t].items() if not k.startswith("b_")}
    assert found.count() == 4
    for r in statistics.balanced_statistics(frame, 2, usable).collect():
        t = r["task_slug"]
        for k in ("win_win_rows", "win_win_eligible_wins", "win_lose_state_count", "win_win_state_count", "positive_state_count"):
            assert r[k] == want[t][f"b_{k}"]
        assert r["unique_positive_trajectory_count"] == len(ids[t]["b_unique_positive_trajectory_count"]) and r["win_lose_rows"] == want[t]["observed_win_lose_rows"]


# -- reports


def test_reports_of_runs_and_seeds(spark):
    rows = [("s", 1, "a", True, False, "x", "p"), ("s", 1, "b", True, False, "x", "p"), ("s", 1, "c", True, True, "y", "p"), ("s", 1, "d", False, False, None, ""), ("s", 2, "e", True, False, None, ""), ("s", 2, "f", False, False, "z", "q"), ("u", 1, "g", False, True, None, None)]
    frame = spark.createDataFrame(rows, "suite string, seed int, trajectory_id string, is_success boolean, aborted boolean, strategy string, signature string")
    got = {(r["suite"], r["seed"]): r for r in reports.run_report(frame, ["suite", "seed"]).collect()}
    one = got["s", 1]
    assert (one["trajectory_count"], one["non_aborted_count"], one["aborted_count"], one["success_count"], one["success_at_k"], one["esd"], one["top1_share"], one["unique_total_strategy_count"]) == (4, 3, 1, 2, 0.5, 0.25, 1.0, 1)
    assert (one["missing_signature_count"], one["missing_success_signature_count"], one["undefined_strategy_key_count"], one["entropy_effective_success_strategy_count"]) == (1, 0, 1, 1.0)
    assert got["s", 2]["missing_success_signature_count"] == 1 and got["s", 2]["unique_success_strategy_count"] == 1 and got["u", 1]["success_at_non_aborted"] == 0
    with pytest.raises(ValueError, match="1 successes without a purchase signature: e"):
        reports.run_report(frame, ["suite", "seed"], needs_signature=True)
    seeds = {(r["suite"], r["metric"]): r for r in reports.seed_report(frame, ["suite"]).collect()}
    assert seeds["s", "esd"]["per_seed"] == [0.25, 0.5] and seeds["s", "esd"]["mean"] == 0.375 and seeds["s", "esd"]["std"] == 0.125 and seeds["u", "esd"]["std"] == 0
    assert {r["count"] for r in reports.strategy_counts(frame, ["suite"]).where("strategy = 'x'").collect()} == {2}
    none = reports.over_seeds(spark.createDataFrame([("s", 1, None)], "suite string, seed int, esd double"), ["suite"], metrics=("esd",)).first()
    assert (none["status"], none["mean"], none["per_seed"]) == ("missing", None, [])
