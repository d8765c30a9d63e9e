"""Functions that no query reaches: each against what it must give, by hand or by plain Python."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.functions import python_text as pt
from tracewright.functions import text
from tracewright.operators import artifacts, bases, branching, checks, divpo, diversity, episodes, planning, records, resume, sft, targets
from tracewright.operators import candidates as cand
from tracewright.plans import stages
from tracewright.sources import traces
from tracewright.streaming import ledger

CALL = "struct<episode_step: int, instruction: string, observation: string, thought: string, action: string, raw_output: string, reward: double, progression: double, done: boolean, won: boolean, lost: boolean, termination_reason: string, extras: struct<abort_reason: string>>"
NAMES = [p.split(":")[0].strip() for p in CALL.removeprefix("struct<").split(", extras")[0].split(",")]


def call(**fields):
    return tuple(fields.get(n) for n in NAMES) + ((fields.get("abort_reason"),),)


def with_calls(spark, *rows):
    return spark.createDataFrame(list(rows), f"id string, calls array<{CALL}>")


def one(frame, column):
    return frame.select(column.alias("x")).first()["x"]


# -- episodes and bases


def test_siblings_and_artifacts(spark):
    on = ["folder", "stem"]
    rows = spark.createDataFrame([("a", "1", "BabyAI", "t"), ("a", "2", "babyai", " "), ("a", "3", "webshop", "t"), ("b", "1", "babaisai", "u"), ("b", "2", "babyai", "t")], "folder string, stem string, env_name string, task_or_env_params string")
    steps = spark.createDataFrame([("a", "1", 0), ("a", "1", 1), ("a", "2", 0), ("a", "3", 0), ("b", "1", 0)], "folder string, stem string, step int")
    logs = spark.createDataFrame([("a", "1", True), ("a", "2", True), ("a", "3", True), ("b", "1", False), ("b", "2", True)], "folder string, stem string, won boolean")
    names = lambda d: sorted((r["folder"], r["stem"]) for r in d.collect())
    assert names(episodes.siblings(rows, steps, logs, on)) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]
    assert names(episodes.artifacts(rows, steps, logs, on)) == [("a", "1"), ("b", "1")]
    assert names(episodes.artifacts(rows, steps, logs, on, task="u")) == [("b", "1")] and names(episodes.artifacts(rows, steps, logs, on, won=F.col("won"))) == [("a", "1")]


def test_last_known_and_aborted(spark):
    frame = with_calls(spark, ("x", [call(progression=0.5), call(progression=None, termination_reason="Aborted: limit")]), ("y", [call(termination_reason="ABORTED")]), ("z", [call(abort_reason=" cap ")]), ("w", []), ("n", None))
    got = {r["id"]: tuple(r)[1:] for r in frame.select("id", episodes.last_known(F.col("calls"), "progression"), episodes.is_aborted(F.col("calls")), episodes.is_aborted(F.col("calls"), missing=False, exact=True)).collect()}
    assert got == {"x": (0.5, True, False), "y": (None, True, True), "z": (None, True, True), "w": (None, False, False), "n": (None, True, False)}


def test_branch_details_and_scores(spark):
    frame = with_calls(spark, ("a", [call(action=" go ", raw_output=""), call(action="stop", raw_output=" said ", progression=0.0, reward=1.0)]), ("b", []))
    got = {r["id"]: r["d"] for r in frame.select("id", records.branch_details(F.col("calls"), F.lit(9), F.lit(None).cast("boolean")).alias("d")).collect()}
    assert tuple(got["a"]) == ("stop", "said", True, 1.0) and got["b"] is None
    assert tuple(one(frame.where("id = 'a'"), records.branch_details(F.col("calls"), F.lit(-3), F.lit(False)))) == ("go", "Action: go", False, 1.0)
    pair = spark.createDataFrame([(0.0, 3.0), (0.4, 3.0), (None, 2.0), (None, None)], "p double, r double")
    assert [r[0] for r in pair.select(artifacts.branch_score(F.col("p"), F.col("r"))).collect()] == [3.0, 0.4, 2.0, None]
    assert [r[0] for r in pair.select(artifacts.first_metric(F.col("p"), F.col("r") * 10)).collect()] == [0.0, 0.4, 0.2, None]


def test_environments_manifests_and_runs(spark):
    maps = spark.createDataFrame([({"a": 1, "b": 2},), ({},), (None,)], "m map<string,int>")
    assert [r[0] for r in maps.select(bases.first_environment(F.col("m"))).collect()] == [1, None, None]
    rows = spark.createDataFrame([("u/t", 2, "s2", "p2"), ("u/t", 1, "s9", "p1"), ("v/w", 0, "s0", "p0")], "task_id string, episode_idx int, run_stem string, trace_path string")
    full = rows.withColumns({c: F.lit(None).cast("string") for c in ("csv_path", "json_path", "episode_return", "progression")} | {"episode_id": F.lit("e"), "seed": F.lit(1), "total_steps": F.lit(3), "success": F.lit(True)})
    said = bases.manifest_rows(full).first()
    assert said["episode_return"] == 0.0 and said["progression"] == 0.0 and set(said.asDict()) >= {"task_id", "run_stem", "seed", "success"}
    assert [r["trace_path"] for r in bases.of_run(rows).collect()] == ["p1", "p2", "p0"] and [r["trace_path"] for r in bases.of_run(rows, "u/t").collect()] == ["p1", "p2"]
    assert tuple(bases.supervised_counts(spark.createDataFrame([("a", "t"), ("a", "t"), ("b", "s")], "trajectory_id string, task_id string")).first()) == (3, 2, ["s", "t"])


def test_base_summaries_and_totals(spark):
    rows = spark.createDataFrame([("b", True), ("a", False), ("b", None)], "task_id string, won boolean")
    assert tuple(bases.base_summary(rows).first()) == (3, 1, ["a", "b"]) and tuple(bases.base_summary(rows.limit(0)).first()) == (0, 0, [])
    sets = spark.createDataFrame([([1, 2],), ([],), (None,)], "branches array<int>")
    assert tuple(bases.branch_totals(sets).first()) == (3, 2)
    slug = lambda *xs: spark.createDataFrame([(x,) for x in xs], "task_slug string")
    assert sorted(r[0] for r in bases.task_slugs(slug("a", "b", "a"), slug("b", "c")).collect()) == ["a", "b", "c"]
    wl, ww = spark.createDataFrame([(1, "l")], "i int, k string"), spark.createDataFrame([(2, "w"), (3, "w")], "i int, k string")
    assert Counter(r["i"] for r in bases.training_records(wl, ww, "win_lose+win_win", 3).collect()) == {1: 1, 2: 3, 3: 3}


def test_check_bases_and_seeds(spark):
    good = spark.createDataFrame([(["a", ""],), (["b"],)], "actions array<string>")
    assert records.check_bases(good, 2).count() == 2
    with pytest.raises(ValueError, match="2 trajectories, 3 expected"):
        records.check_bases(good, 3)
    with pytest.raises(Exception, match="an action is not empty"):
        records.check_bases(spark.createDataFrame([([" "],)], "actions array<string>"), 1).collect()
    n = spark.createDataFrame([(100, 7)], "b int, e int")
    assert one(n, records.episode_seed(F.col("b"), F.col("e"))) == 107 and one(n, records.episode_seed(F.col("b"), F.col("e"), fixed=True)) == 100


# -- branching and planning


def test_spread_steps_and_caps(spark):
    def by_hand(steps, count):
        if count <= 0 or len(steps) <= max(count, 1):
            return steps
        if count == 1:
            return [steps[len(steps) // 2]]
        return sorted({steps[round(k * (len(steps) - 1) / (count - 1))] for k in range(count)})

    some = [list(range(0, 2 * n, 2)) for n in range(12)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(some)], "i int, s array<int>")
    for count in (0, 1, 2, 3, 5):
        got = [r[0] for r in frame.orderBy("i").select(branching.spread_steps(F.col("s"), count)).collect()]
        assert got == [by_hand(s, count) for s in some], count
    caps = spark.createDataFrame([(5, None, 9), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in caps.select(branching.step_cap(F.col("a"), F.col("b"), F.col("c"))).collect()] == [5, None]


def test_unfilled_ranks_and_attempts(spark):
    key = ["b", "i"]
    wanted = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0)], "b string, i int")
    got = branching.unfilled(wanted, wanted.where("i = 0 and b = 'x'"), key, "request_alt_unavailable")
    assert sorted(tuple(r) for r in got.collect()) == [("x", 1, "request_alt_unavailable"), ("y", 0, "request_alt_unavailable")]
    assert {(r["b"], r["i"]): r["rank"] for r in branching.rank_within(wanted, "b", "i").collect()} == {("x", 0): 1, ("x", 1): 2, ("y", 0): 1}
    tried = spark.createDataFrame([("x", 0, 1, "a"), ("x", 0, 3, "c"), ("x", 0, 2, "b"), ("y", 0, 1, "a")], "b string, i int, ord int, status string")
    assert {(r["b"]): (r["status"], r["job_attempts"]) for r in planning.with_attempts(tried, key).collect()} == {"x": ("c", 3), "y": ("a", 1)}
    sums = spark.createDataFrame([("t", None, None, 5, 2), ("t", "b", 1, 5, 2), ("u", None, None, 1, 0)], "task_slug string, base_traj_id string, divergence_step int, generated long, failed long")
    assert tuple(planning.totals(sums).first()) == (6, 2, 2)


def test_records_that_are_complete_and_statuses(spark):
    rows = spark.createDataFrame([("a", 1, "generated", True), ("a", 2, "retry_exhausted", True), ("b", 1, "generated", False), ("c", 1, "replay_mismatch", False), ("c", 2, "generated", True)], "k string, ord int, status string, files_exist boolean")
    assert {(r["k"], r["ord"]) for r in resume.complete(rows, ["k"]).collect()} == {("a", 1), ("c", 2)}
    lists = spark.createDataFrame([(["retry_exhausted", "worker_exception"],), (["generated"],), ([],)], "s array<string>")
    assert [r[0] for r in lists.select(resume.all_retryable(F.col("s"))).collect()] == [True, False, False]


# -- texts


def test_admissible_commands(spark):
    said = ["look\nAvailable commands (choose exactly one as your final Action):\n- go \n- take  it\n\n- go\nelse\n- no", "Available commands (choose exactly one as your final Action):", "none", None, "Available commands (choose exactly one as your final Action):\n\n- a\nAvailable commands (choose exactly one as your final Action):\n- b"]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string")
    assert [r[0] for r in frame.orderBy("i").select(text.admissible_commands(F.col("t"))).collect()] == [["go", "take it"], [], [], [], ["a"]]


def test_response_formats_and_pages(spark):
    frame = spark.createDataFrame([([("user", "Baba Is You is a puzzle game where")], "up"), ([("user", "You are")], " go "), ([], "x")], "p array<struct<role: string, content: string>>, a string")
    rows = frame.select(text.response_format(F.col("p")).alias("f"), text.fixed_action_format(F.col("p"), F.col("a")).alias("g")).collect()
    assert [("exactly one of" in r["f"], "<one short thought>" in r["g"]) for r in rows] == [(True, True), (False, False), (False, False)]
    assert rows[1]["g"].splitlines()[2] == "Thought: <your thoughts>" and "\nAction: go\n" in rows[1]["g"] and rows[0]["g"].endswith("after the Thought line.")
    with pytest.raises(Exception, match="no action"):
        frame.select(text.fixed_action_format(F.col("p"), F.lit(" "))).collect()
    pages = spark.createDataFrame([("see", ["search[a]", "click[b]"]), ("see", ["click[back to search]"]), ("see", ["click[x]"]), ("see", []), (None, None)], "o string, a array<string>")
    got = [r[0] for r in pages.select(text.page_prompt(F.col("o"), F.col("a"))).collect()]
    assert got[0].startswith("see\n\nAvailable actions for this state:\n- search[a]\n- click[b]\n\nThis is the search page.") and got[3] == "see" and got[4] == ""
    assert got[1].endswith("before a new search.") and got[2].endswith("Do not output search[...].") and "Search is not available" not in got[2]


def test_the_models_action(spark):
    rows = [("up", "x", "up"), (" ", "Thought: a\nAction: go left", "go left"), (None, "turn right", "turn right"), (None, None, ""), ("", "  ", "")]
    frame = spark.createDataFrame(rows, "p string, r string, w string").select(pt.model_action("p", "r").alias("m"), "w")
    assert all(r["m"] == r["w"] for r in frame.collect())


# -- supervised rows, losses, diversity


def test_plans_are_checked_and_reported(spark):
    plan = spark.createDataFrame([(0, "a"), (0, "b"), (3, None), (2, "a")], "row_idx long, mode string")
    assert sft.checked_plan(plan, 4).count() == 4
    r = sft.plan_report(plan, 8).first()
    assert (r["plan_rows"], r["source_rows"], r["distinct_rows"], r["resample_ratio"], r["mode_counts"]) == (4, 8, 3, 0.5, {"a": 2, "b": 1, "unknown": 1}) and abs(r["reuse_ratio"] - 4 / 3) < 1e-12
    for bad, n in (([(4,)], 4), ([(-1,)], 4), ([(None,)], 4)):
        with pytest.raises(Exception, match="out of range for 4 rows"):
            sft.checked_plan(spark.createDataFrame(bad, "row_idx long"), n).collect()
    with pytest.raises(Exception, match="1.5 is out of range"):
        sft.checked_plan(spark.createDataFrame([("1.5",)], "row_idx string"), 4).collect()
    with pytest.raises(ValueError, match="no rows"):
        sft.checked_plan(plan.limit(0), 4)


def test_requested_tasks(spark):
    rows = spark.createDataFrame([("a/x",), ("b/x",), ("c/y",), ("y",), (None,)], "task_id string")
    assert sft.of_requested_task(rows, None).count() == 5 and sft.of_requested_task(rows, "a/x").count() == 1 and sft.of_requested_task(rows, "y").count() == 1 and sft.of_requested_task(rows, "unknown").count() == 1
    for name, why in (("x", "ambiguous: a/x, b/x"), ("z", "no rows of task z"), (" ", "empty")):
        with pytest.raises(ValueError, match=why):
            sft.of_requested_task(rows, name)


def test_balance_by_trajectory_or_family(spark):
    rows = spark.createDataFrame([("t", None, i) for i in range(5)] + [(" ", "f", 0)], "trajectory_id string, family_id string, i int")
    got = Counter(r["trajectory_id"].strip() or r["family_id"] for r in sft.by_trajectory(rows, "i").collect())
    assert got == {"t": 3, "f": 3}
    with pytest.raises(Exception, match="neither trajectory nor family"):
        sft.by_trajectory(spark.createDataFrame([(None, "", 0)], "trajectory_id string, family_id string, i int"), "i").collect()


def test_window_means(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, None), (7, 5.0)], "step int, loss double")
    assert sorted(tuple(r) for r in targets.window_means(rows, ["loss"], 2).collect()) == [(0, 1, 2.0), (1, 2, None), (3, 7, 5.0)]


def test_diversity_by_log_probability(spark):
    rows = spark.createDataFrame([("a", 0, "x", 1), ("a", 0, "x", 2), ("b", 0, None, 3)], "trajectory_id string, divergence_step int, response_text string, n int")
    asked = []

    def scorer(keys):
        asked.append(keys.count())
        return keys.withColumn("logprob", -F.coalesce(F.length("response_text"), F.lit(7)).cast("double"))

    assert {r["n"]: r["diversity_score"] for r in divpo.with_logprob(rows, scorer).collect()} == {1: 1.0, 2: 1.0, 3: 7.0} and asked == [2]


def test_run_diversity_by_rule(spark):
    rng = random.Random(2)
    steps, eps, want = [], [], defaultdict(list)
    for t in range(60):
        acts = [rng.choice(["turn left", "turn right", "go"]) for _ in range(rng.randrange(1, 7))]
        valid, won = rng.random() < 0.9, rng.random() < 0.7
        eps.append((str(t), t % 2, valid, won))
        steps += [(str(t), i, a, a) for i, a in enumerate(acts)]
        if valid and won:
            want[t % 2].append(tuple(acts))
    frame = spark.createDataFrame(steps, "trajectory_id string, step int, action string, turn_action string")
    got = {r["run"]: r for r in diversity.run_diversity(spark.createDataFrame(eps, "trajectory_id string, run int, is_valid boolean, is_success boolean"), frame, ["run"], "none").collect()}
    for run, seqs in want.items():
        r = got[run]
        assert (r["episode_count"], r["success_count"], r["raw_unique"], r["effective_unique"], r["removed_actions"]) == (30, len(seqs), len(set(seqs)), len(set(seqs)), 0)
    pruned = {r["run"]: r for r in diversity.run_diversity(spark.createDataFrame(eps, "trajectory_id string, run int, is_valid boolean, is_success boolean"), frame, ["run"]).collect()}
    assert all(pruned[r]["raw_unique"] == got[r]["raw_unique"] and pruned[r]["effective_unique"] <= got[r]["raw_unique"] for r in got) and any(pruned[r]["removed_actions"] for r in got)


def test_quality_scores_by_name(spark):
    rows = spark.createDataFrame([("t", 0, "o", "a"), ("t", 1, "o", "a")], "trajectory_id string, step int, obs_pre string, action string")
    assert cand.quality(rows).first()["max_run"] == 2
    with pytest.raises(ValueError, match="no quality score x"):
        cand.quality(rows, "x")


# -- files, plans and streams


def test_paths_manifests_and_logs(spark, tmp_path):
    paths = spark.createDataFrame([("/r/a/b",), ("/other/b",)], "p string")
    assert [r[0] for r in paths.select(traces.portable(F.col("p"), "/r")).collect()] == ["a/b", "/other/b"]
    assert traces.manifest_text({"b": 1, "a": {"d": 2, "c": None}}) == '{\n  "a": {\n    "c": null,\n    "d": 2\n  },\n  "b": 1\n}\n'
    for name in ("x_run_1.json", "x_run_1_llm_trace.json", "x_run_1_summary.json", "other.json"):
        (tmp_path / name).write_text(json.dumps({"v": name}))
    assert [(r["v"], r["stem"]) for r in traces.episode_logs(spark, str(tmp_path), "v string").collect()] == [("x_run_1.json", "x_run_1")]
    said = stages.manifest("build", stages.PairConfig(), {"rows": 3})
    assert (said["stage"], said["outputs"], said["config"]["method"], said["status"]) == ("build", {"rows": 3}, "dpo", "ok")


def test_ids_and_step_sequences(spark, tmp_path):
    ids = spark.createDataFrame([("e", "p"), (" ", "q")], "episode_id string, trace_path string")
    with pytest.raises(Exception, match="no episode id in q"):
        traces.with_ids(ids).collect()
    assert traces.with_ids(ids.where("trace_path = 'p'")).count() == 1
    (tmp_path / "one.csv").write_text(",".join(traces.STEP_COLUMNS) + "\n" + "".join(f"{i}," + "," * 4 + f"{a}" + "," * (len(traces.STEP_COLUMNS) - 6) + "\n" for i, a in ((10, "last"), (2, " mid "), (0, "first"), (1, " "))))
    rows = traces.step_sequences(traces.step_files(spark, str(tmp_path))).collect()
    assert [(r["stem"], r["values"]) for r in rows] == [("one", ["first", "mid", "last"])]


def test_schema_difference(spark):
    a, b = spark.createDataFrame([], "x int, y int"), spark.createDataFrame([], "y int, z int")
    assert checks.schema_difference(a, b) == (["x"], ["z"])


def test_runner(spark):
    run = stages.Runner()
    for name in stages.STAGES:
        run.registry.add(name, lambda done, name=name: [*done, name])
    assert run.run("sft", "build") == {"sft": ["sft"], "collect": ["sft", "collect"], "build": ["sft", "collect", "build"]}
    assert stages.Runner(run.registry, dry_run=True).run() == dict.fromkeys(stages.STAGES)
    with pytest.raises(stages.ConfigError, match="no base"):
        stages.Runner().run()
    broken = stages.Runner()
    broken.registry.add("eval", lambda done: 1 / 0)
    with pytest.raises(ZeroDivisionError) as e:
        broken.run("eval", "eval")
    assert e.value.__notes__ == ["in stage eval"]


def test_configuration_of_a_stage():
    config = {"benchmark": {"name": "b", "task_filter": "f", "task_group": "g", "train_task_filters": ["x"], "upstream_path": None}, "models": {"target_model": "t", "reference_model": "r", "target_base_url": "u"}, "runtime": {"seed": 1, "cuda_visible_devices": "0"}, "dataset": {"k": 1}, "evaluation": {"n": 3}}
    said = stages.config_of(config, "build")
    assert said["dataset"] == {"k": 1} and said["models"] == {"target_model": "t", "reference_model": "r"} and said["runtime"] == {"cuda_visible_devices": "0"} and said["benchmark"]["task_scope"] == "g"
    assert stages.config_of(config, "eval")["benchmark"]["task_scope"] == "f" and stages.config_of(config, "eval")["benchmark"]["evaluation_task_filter"] == "f"
    with pytest.raises(stages.ConfigError, match="lacks training"):
        stages.config_of(config, "train")


def test_each_key_once_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.json(f"{tmp_path}/in")
    stream = ledger.once(ledger.records(spark, f"{tmp_path}/in", "k string, t timestamp"), ["k"], "t", "1 hour")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_seeded_alternatives(spark):
    """Samples hang on the seed's parts alone, hold no base action, are as many as asked for, and whole for a budget of 0."""
    every, kinds = ["search[a]", "click[b]", "click[c]", "click[buy now]", "click[d]"], ["search", "product_click", "product_click", "buy_now", "option_click"]
    rows = [(every, kinds, "click[b]", "product_click", n, f"k{k}") for n in (0, 2, 9) for k in range(20)]
    frame = spark.createDataFrame(rows, "a array<string>, k array<string>, base string, own string, n int, key string")
    made = frame.select("n", "key", pt.shop_alternatives("a", "base", "n", "key").alias("s"), pt.structured_alternatives("a", "k", "base", "own", "n", "key").alias("t"), pt.random_steps(F.lit(9), "n", "key").alias("r"))
    got, again = made.collect(), made.repartition(5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    for r in got:
        for some in (r["s"], r["t"]):
            assert len(some) == len(set(some)) == (2 if r["n"] == 2 else 4) and "click[b]" not in some
        assert r["t"][0] == "click[c]"  # of the base action's kind
        assert r["r"] == sorted(r["r"]) and len(r["r"]) == (2 if r["n"] == 2 else 8) and set(r["r"]) <= set(range(1, 9))
    assert len({tuple(r["s"]) for r in got if r["n"] == 2}) > 3
