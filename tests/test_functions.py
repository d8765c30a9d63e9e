import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import casts, outcomes, text
from tracewright.functions import python_text as pt
from tracewright.operators import branching, candidates, checks, diversity, episodes, pairs, resume, sft, targets
from tracewright.operators.zip import balanced_zip, replicate
from tracewright.plans.stages import ConfigError, PairConfig, Registry, scored, stages_between
from tracewright.sources import traces


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_casts(spark):
    assert column(spark, ["7", " 7 ", "7.0", "", None, "x", "true"], lambda v: casts.int_or(v, -1)) == [7, 7, -1, -1, -1, -1, 1]
    assert column(spark, [7.9, -7.9, None, float("nan"), 0.2], lambda v: casts.int_or(v, -1), "double") == [7, -7, -1, -1, 0]
    assert column(spark, ["1e3", "x", None], lambda v: casts.float_or(v, 0.5)) == [1000.0, 0.5, 0.5]
    assert column(spark, ["Yes", "0", " TRUE", "2", None], casts.bool_or_null) == [True, False, True, None, None]
    assert column(spark, [float("nan"), None, 1.0, 0.9], lambda v: casts.at_least(v, 1.0), "double") == [False, False, True, False]
    assert column(spark, ["  a \n", None], casts.strip) == ["a", ""]


def test_actions(spark):
    got = column(spark, ["  Search[ A  b ]", "'CLICK[Buy Now]'", "click[b00abc1234]", "click[Next >]", "click[reviews]", "click[red]", "go", None], text.shop_action_type)
    assert got == ["search", "buy_now", "product_click", "navigation", "info_tab", "option_click", "other", "other"]
    got = column(spark, [["search[a]", "click[buy now]", "click[b00abc1234]", "click[x", "no"], []], text.type_signature, "array<string>")
    assert got == ["search > click:buy now > click:product > click:option > other", ""]


def test_search_queries(spark):
    got = column(spark, ["Instruction: find me red running shoes with color: dark blue, and price lower than 40.00 dollars", "", None], text.search_queries)
    assert got[0][0] == "red running shoes" and len(got[0]) == len(set(got[0])) <= 6
    assert got[1] == [] and got[2] == []


def test_response_text(spark):
    rows = spark.createDataFrame([("raw", "t", "a"), ("a", "t", "a"), ("a", "", "a"), ("", None, None)], "r string, t string, a string")
    got = [r[0] for r in rows.select(text.response_text(F.col("r"), F.col("t"), F.col("a"))).collect()]
    assert got == ["raw", "Thought: t\nAction: a", "Action: a", ""]


def test_stable_int(spark):
    want = int(hashlib.sha1(b"a\n<SEP>\nb").hexdigest()[:16], 16)
    got = spark.range(1).select(text.stable_int(F.lit("a"), F.lit("b"))).first()[0]
    assert int(got) == want == pt.seed_of("a", "b")


def test_free_text_actions():
    assert pt.action_in("Thought: go\nAction: - `up`") == "up"
    assert pt.action_in("x <|ACTION|> left <|END|>") == "left"
    assert pt.action_in("I think.\nturn left") == "turn left"
    assert pt.action_in("It is so. It is.") == "It is so. It is."
    assert pt.action_in(None) == ""
    assert pt.thought_and_action_in("Thought: a\nb\nAction: go # fast") == ("a\nb", "go")


def test_seeded_samples(spark):
    got = spark.range(1).select(pt.random_alternatives(F.array(*map(F.lit, "abcd")), F.lit("a"), F.lit(2), F.lit("k"))).first()[0]
    assert got == random.Random(pt.seed_of("dtc_random_alt_actions", "k", "a", 2)).sample(["b", "c", "d"], k=2)


def test_outcomes(spark):
    rows = spark.createDataFrame([("the_cooking_game", 0.6, 0.0), ("coin_collector", 0.99, 0.0)], "s string, p double, r double")
    assert [r[0] for r in rows.select(outcomes.by_game(F.col("s"), F.col("p"))).collect()] == [True, False]
    none = F.lit(None).cast("boolean")
    assert [r[0] for r in rows.select(outcomes.for_training(F.col("s"), none, F.col("p"), none, F.col("r"))).collect()] == [True, False]


def turns_by_hand(actions):
    kept, i = [], 0
    while i < len(actions):
        j = i
        while j < len(actions) and actions[j] in diversity.TURNS:
            j += 1
        block = actions[i:j]
        n = len(block)
        if not block:
            kept.append(actions[i])
            i += 1
            continue
        if len(set(block)) == 1:
            kept += block[: n % 4]
        elif n >= 4 and all(a != b for a, b in zip(block, block[1:], strict=False)):
            kept += block[n - n % 2 :]
        else:
            kept += block
        i = j
    return kept


def test_prune_turns(spark):
    rnd = random.Random(3)
    every = [[rnd.choice(["turn left", "turn right", "go"]) for _ in range(rnd.randint(1, 12))] for _ in range(400)]
    rows = spark.createDataFrame([(str(i), k, a) for i, s in enumerate(every) for k, a in enumerate(s)], "trajectory_id string, step int, turn_action string")
    kept = diversity.prune_turns(rows)
    got = {r["trajectory_id"]: [a for a in r["actions"] if a is not None] for r in diversity.sequences(kept, "turn_action", F.col("keep")).collect()}
    assert got == {str(i): turns_by_hand(s) for i, s in enumerate(every)}


def test_prune_loops(spark):
    rows = [("a", 0, "up", 1, 2, False), ("a", 1, "down", 2, 1, False), ("a", 2, "idle", 1, 1, False), ("a", 3, "left", 1, 3, True), ("b", 0, "idle", 5, 5, False)]
    frame = spark.createDataFrame(rows, "trajectory_id string, step int, action string, obs_pre int, obs_post int, final boolean")
    assert {r[0]: (r[1], r[2]) for r in diversity.prune_loops(frame).collect()} == {"a": (["left"], 3), "b": ([], 1)}


def test_longest_repeat_counts_nulls_as_empty(spark):
    rows = spark.createDataFrame([("t", 0, None, None), ("t", 1, "", ""), ("t", 2, "x", "a")], "trajectory_id string, step int, obs_pre string, action string")
    assert [tuple(r) for r in candidates.longest_repeat(rows).collect()] == [("t", 2)]


def test_uniform_steps(spark):
    def by_hand(total, k):
        every = list(range(1, total))
        if not every or k <= 0 or k >= len(every):
            return every
        if k == 1:
            return every[-1:]
        return sorted({every[0], every[-1], *(every[round(s * (len(every) - 1) / (k - 1))] for s in range(1, k - 1))})

    for k in (0, 1, 2, 3, 5):
        got = column(spark, list(range(0, 25)), lambda v, k=k: branching.uniform_steps(v, k), "int")
        assert got == [by_hand(n, k) for n in range(25)]


def test_resample(spark):
    rows = spark.createDataFrame([(n, t) for n in range(1, 7) for t in range(0, 9)], "n bigint, t bigint")
    for r in rows.select("n", "t", sft.resampled_index(F.col("n"), F.col("t")).alias("x")).collect():
        n, t = r["n"], r["t"]
        want = [i % n for i in range(t)] if t >= n else [min(n - 1, (2 * i + 1) * n // (2 * t)) for i in range(t)]
        assert r["x"] == want


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 40), st.integers(1, 9))
def test_shard_sizes(spark, n, workers):
    rows = branching.shards(spark.range(n), "id", workers).collect()
    base, more = divmod(n, workers)
    want = [w for w in range(workers) for _ in range(base + (w < more))]
    assert [r["worker"] for r in sorted(rows, key=lambda r: r["id"])] == want


def test_shards_of_wide_rows_are_ntiles(spark):
    """Partitions that adaptive execution would join, were their number not given."""
    known = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300000")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rows = spark.range(30_000).select((F.col("id") * 7919 % 30_011).alias("k"), F.repeat(F.sha1(F.col("id").cast("string")), 4).alias("wide"))
        got = branching.shards(rows, "k", 7)
        want = rows.select("k", (F.ntile(7).over(Window.orderBy("k")) - 1).cast("long").alias("want"))
        assert got.join(want, "k").where(~F.col("worker").eqNullSafe(F.col("want"))).count() == 0 and got.count() == 30_000
        ranks, n = branching.ranked(rows, "k")
        assert n == 30_000 and ranks.agg(F.countDistinct("rank"), F.max("rank")).first() == (30_000, 29_999)
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
    assert branching.shards(rows.limit(0), "k", 3).count() == 0


def test_ledger_keeps_the_last_batch_of_a_key(spark, tmp_path):
    from tracewright.streaming import ledger

    schema = "k string, status string, ord int"
    for number, rows in enumerate(([("a", "x", 5), ("b", "y", 1)], [("a", "z", 1)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/l/{ledger.BATCH}={number}")
    want = {("a", "z", 1), ("b", "y", 1)}
    assert {tuple(r) for r in ledger.holding(spark, f"{tmp_path}/l", ["k"]).collect()} == want
    ledger.compact(spark, f"{tmp_path}/l", f"{tmp_path}/c", ["k"])
    spark.createDataFrame([("b", "w", 0)], schema).write.parquet(f"{tmp_path}/c/{ledger.BATCH}=0")
    assert {tuple(r) for r in ledger.holding(spark, f"{tmp_path}/c", ["k"]).collect()} == {("a", "z", 1), ("b", "w", 0)}


def test_labels_in_free_text():
    assert pt.action_in("reaction: a\nStep 2: **\n- Step 3: b") == "a"
    assert pt.thought_and_action_in("Thought:\nAction: go\nmore\nAction: up") == ("Action: go\nmore", "up")
    assert pt.clean_action("12) 'go  up' (now) ") == "go up'" and pt.clean_action("a (b (c))") == "a (b (c))"


def test_targets_and_weights(spark):
    wins = spark.createDataFrame([(1, 0, "s", -1.0), (1, 0, "s", -900.0), (2, 0, "s", -3.0)], "family_id int, divergence_step int, state_key string, ref_logprob double")
    for eta in (0.0, 0.5, 1.0):
        sums = targets.state_targets(wins, eta).groupBy("family_id").agg(F.sum("state_prob")).collect()
        assert all(abs(r[1] - 1) < 1e-12 for r in sums)
    weighted = pairs.balancing_weights(wins).collect()
    assert abs(sum(r["pair_weight"] for r in weighted) - 3) < 1e-12


def test_losses_are_stable(spark):
    rows = spark.createDataFrame([(1e4, False, 1.0), (-1e4, True, 0.5)], "gap double, is_tie boolean, target double")
    assert all(v == v and abs(v) < 1e6 for r in rows.select(*targets.loss_terms().values()).collect() for v in r)


def test_resume(spark):
    schema = "k string, status string, files_exist boolean, ord int"
    rows = spark.createDataFrame([("a", "generated", True, 1), ("a", "worker_exception", True, 2), ("b", "generated", False, 1), ("c", "replay_failed", None, 1)], schema)
    jobs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert {r[0] for r in resume.remaining(jobs, rows, ["k"]).collect()} == {"b", "d"}
    assert {r["k"]: r["status"] for r in resume.latest(rows, ["k"]).collect()}["a"] == "worker_exception"
    assert resume.merged(rows, rows.limit(0), ["k"]).count() == 3
    asked = spark.createDataFrame([("j", "a"), ("j", "b"), ("i", "c")], "job string, k string")
    assert [r[0] for r in resume.remaining_requests(asked, rows, ["job"], ["k"]).collect()] == ["j"]


def test_checks(spark):
    rows = spark.createDataFrame([("a", "", 2.0, 1.0, "win_win")], "chosen string, rejected string, target_prob double, weight double, pair_type string")
    assert {r["rule"] for r in checks.violations(rows, checks.pair_rules()).collect()} == {"rejected is not empty", "target is a probability"}
    assert checks.one_value(spark.range(3).select(F.lit(0.1).alias("b")), "b", 0.1)


def test_zip_and_replicate(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "i bigint, v string")
    b = spark.createDataFrame([(0, "p"), (1, "q")], "i bigint, v string")
    got = {r["place"]: (r["a_v"], r["b_v"]) for r in balanced_zip(a, b).collect()}
    assert got == {0: ("x", "p"), 1: ("y", "q"), 2: ("z", "p")}
    assert replicate(a, 3).count() == 9 and replicate(a, 0).count() == 0
    assert balanced_zip(a, b.limit(0)).count() == 0


def test_plans(spark):
    assert stages_between("collect", "train") == ["collect", "build", "train"]
    for bad in ({"eta": 2.0}, {"nothing": 1}):
        try:
            PairConfig.of(bad)
            raise AssertionError
        except ConfigError:
            pass
    registry = Registry()
    registry.add("len", lambda rows: rows.withColumn("score", F.length("k")))
    rows = spark.createDataFrame([("aa",), ("aa",), ("b",)], "k string")
    assert sorted(r["score"] for r in scored(rows, registry.get("len"), ["k"]).collect()) == [1, 2, 2]


def test_traces_round_trip(spark, tmp_path):
    import json

    (tmp_path / "run" / "_dtc").mkdir(parents=True)
    call = {"action": "go", "observation": "o", "extras": {"balrog_raw": {"messages": [{"role": "user", "content": " hi "}, {"role": "", "content": "x"}]}}}
    for name, body in {"run/a_llm_trace.json": {"episode_id": "", "calls": [call, call]}, "run/_dtc/b_llm_trace.json": {"episode_id": "b", "calls": [call]}}.items():
        (tmp_path / name).write_text(json.dumps(body))
    base = traces.traces(spark, str(tmp_path))
    assert [r["episode_id"] for r in base.collect()] == ["a"]
    assert traces.traces(spark, str(tmp_path), branches=[str(tmp_path / "run" / "_dtc")]).count() == 2
    got = traces.steps_of(traces.with_calls(base)).select(text.messages(F.col("extras.balrog_raw.messages")).alias("m")).collect()
    assert len(got) == 2 and [tuple(m) for m in got[0]["m"]] == [("user", "hi")]
    whole = episodes.typed(base).first()
    assert whole["won"] is False and [x["action"] for x in whole["steps"]] == ["go", "go"]
    found = base.select(episodes.outcome(F.col("calls")).alias("o"), episodes.is_aborted(F.col("calls")).alias("x")).first()
    assert found["o"]["num_steps"] == 2 and not found["o"]["success"] and found["x"] is False
    rows = spark.createDataFrame([("a", 'say "x"\nnow'), ("b", None)], "k string, v string")
    traces.write_json_lines(rows, str(tmp_path / "out"))
    assert {tuple(r) for r in traces.json_lines(spark, str(tmp_path / "out"), "k string, v string", non_empty=True).collect()} == {tuple(r) for r in rows.collect()}
    steps = spark.createDataFrame([(*["0"] * 2, 'a "quoted"\nline', *["x"] * 19)], ", ".join(f"`{c}` string" for c in traces.STEP_COLUMNS))
    traces.write_csv(steps, str(tmp_path / "steps"))
    got = traces.step_files(spark, str(tmp_path / "steps")).first()
    assert got["observation_pre"] == 'a "quoted"\nline'
    assert traces.latest_run(["r1", "r3", "r2"]) == "r3"


def test_stream_equals_batch(spark):
    from tracewright.operators.resume import merged
    from tracewright.queries import QUERIES, _branches

    d = "/root/testdata/sf0.001"
    rows = _branches(spark, d).select("task_slug", "base_traj_id", "divergence_step", "alt_index", F.coalesce("status", F.lit("")).alias("status"), "ord")
    got = {tuple(r) for r in QUERIES["stream_resume"](spark, d).select(rows.columns).collect()}
    assert got == {tuple(r) for r in merged(rows.limit(0), rows).select(rows.columns).collect()}
