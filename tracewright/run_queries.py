"""Queries of readers, sinks, prompts, epochs, statistics and reports, beside those of queries.py; all of both are in QUERIES and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import outcomes, text
from .functions import variants as V
from .operators import branching, diversity, divpo, epochs, pairs, prompts, raw_runs, reports, sft, statistics, targets
from .plans.scoring import scored_once
from .queries import BRANCH, MOST_REPEATS, QUERIES, SQL, STATES, _at_states, _branches, _steps, _table, query
from .sources import artifacts as typed
from .sources import commits, strict_lines, training_files
from .sources import event_view as ev
from .sources.shared import new_folder

__all__ = ["QUERIES", "SQL"]

LOTS = 8
SPOILT = "CASE WHEN turn % 7 = 3 THEN '{\"turn\": ' || turn WHEN turn % 11 = 5 THEN '[' || turn || ']' WHEN turn % 5 = 4 THEN '  ' ELSE '{\"conv_id\": ' || conv_id || ', \"turn\": ' || turn || '}' END"


@query(f"""WITH line AS (SELECT conv_id % {LOTS} AS lot, {SPOILT} AS text, row_number() OVER (PARTITION BY conv_id % {LOTS} ORDER BY conv_id, turn, coalesce(text, '')) AS line FROM conversations)
SELECT lot, line, CASE WHEN text LIKE '[%' THEN 'row must be an object' ELSE 'invalid JSON' END AS reason FROM line WHERE text LIKE '[%' OR (text LIKE '{{%' AND text NOT LIKE '%}}')""", with_steps=False)
def line_faults(spark, d):
    """Files of JSON lines made of conversations, some lines spoilt, and the faults that the strict reader finds in them."""
    rows = _table(spark, d, "conversations").select((F.col("conv_id") % LOTS).alias("lot"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    text = F.when(F.col("turn") % 7 == 3, F.concat(F.lit('{"turn": '), "turn")).when(F.col("turn") % 11 == 5, F.concat(F.lit("["), "turn", F.lit("]"))).when(F.col("turn") % 5 == 4, "  ")
    text = text.otherwise(F.concat(F.lit('{"conv_id": '), "conv_id", F.lit(', "turn": '), "turn", F.lit("}")))
    folder = f"{new_folder(spark, 'lines')}/files"
    dealt = rows.repartition(LOTS, "lot").sortWithinPartitions("lot", "conv_id", "turn", "t")
    dealt.select("lot", text.alias("value")).write.partitionBy("lot").text(folder)
    found = strict_lines.faults(spark, folder)
    lot = F.regexp_extract("file", r"lot=(-?\d+)", 1).cast("long")
    return found.select(lot.alias("lot"), F.col("line").cast("long").alias("line"), F.split("reason", ":")[0].alias("reason"))


def _loose(spark, d):
    """Trajectories as loosely typed JSON: seeds as text, wins as numbers, scores missing, and some that can't be read."""
    steps = _steps(spark, d)
    step = F.struct(
        F.col("step").alias("step_index"), F.col("obs_pre").cast("string").alias("observation"), F.col("action"), F.when(F.col("step") % 2 == 0, F.col("reward").cast("string")).alias("reward"), F.col("done").cast("int").alias("done"),
    )
    packed = steps.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    rows = ev.trajectories(steps).join(packed, "trajectory_id")
    fam = F.col("family_id")
    fields = {
        "benchmark": F.lit("events"), "task_id": F.when(fam % 5 != 4, F.col("task_slug")), "trajectory_id": F.col("trajectory_id"), "model_id": F.lit(None).cast("string"),
        "seed": F.when(fam % 3 == 0, F.concat(F.lit(" "), F.col("week").cast("string"))).when(fam % 3 == 1, F.concat(F.col("week").cast("string"), F.lit(".5"))).otherwise(F.col("week").cast("string")),
        "won": (F.col("terminal_progression") >= 1).cast("int"), "score": F.when(fam % 2 == 0, F.round("terminal_reward", 3).cast("string")), "steps": F.col("steps"),
    }
    made = F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))  # null fields are left out
    whole = F.replace(made, F.lit('"benchmark":"events",'), F.lit('"benchmark":"events","model_id":null,'))
    return rows.select("trajectory_id", "family_id", F.when(fam % 13 == 7, F.substring(whole, 1, 40)).otherwise(whole).alias("text"))


SOUND = "family_id % 13 <> 7 AND family_id % 5 <> 4 AND family_id % 3 <> 1"


@query(f"""SELECT trajectory_id, t.task_slug AS task_id, 'None' AS model_id, week AS seed, terminal_progression >= 1 AS won, CASE WHEN family_id % 2 = 0 THEN round(terminal_reward, 3) END AS score, n_steps,
  (SELECT round(sum(reward), 4) FROM step s WHERE s.trajectory_id = t.trajectory_id AND s.step % 2 = 0) AS even_rewards, (SELECT count(*) FILTER (done) FROM step s WHERE s.trajectory_id = t.trajectory_id) AS ends FROM traj t WHERE {SOUND}""")
def typed_trajectories(spark, d):
    good, _ = typed.typed(_loose(spark, d), "trajectory")
    rewards = F.aggregate("steps", F.lit(0.0), lambda s, x: s + F.coalesce(x["reward"], F.lit(0.0)))
    return good.select("trajectory_id", "task_id", "model_id", "seed", "won", "score", F.size("steps").cast("long").alias("n_steps"), F.round(rewards, 4).alias("even_rewards"), F.size(F.filter("steps", lambda x: x["done"])).cast("long").alias("ends"))


@query(f"SELECT CASE WHEN {SOUND} THEN 'none' WHEN family_id % 13 = 7 THEN 'invalid JSON' WHEN family_id % 5 = 4 THEN 'task_id is missing' ELSE 'seed is no whole number' END AS reason, count(*) AS rows FROM traj GROUP BY 1")
def artifact_quarantine(spark, d):
    good, bad = typed.typed(_loose(spark, d), "trajectory")
    both = good.select(F.lit("none").alias("reason")).unionByName(bad.select(F.split("reason", ":")[0].alias("reason")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


RAW = "family_id % 3 <> 0"


@query(f"""SELECT trajectory_id, CASE WHEN week % 2 = 1 THEN t.task_slug WHEN {RAW} THEN 'log-' || t.task_slug ELSE 'given' END AS task_id, CASE WHEN week % 3 = 0 THEN week ELSE 11 END AS seed,
  CASE WHEN {RAW} AND family_id % 2 = 0 THEN terminal_progression >= 1 ELSE (SELECT max(reward) > 45 FROM step s WHERE s.trajectory_id = t.trajectory_id) END AS won,
  CASE WHEN {RAW} AND family_id % 5 <> 0 THEN round(episode_return, 3) ELSE round(terminal_progression, 3) END AS score, (SELECT string_agg(action, '>' ORDER BY step) FROM step s WHERE s.trajectory_id = t.trajectory_id) AS actions, n_steps FROM traj t WHERE family_id % 17 <> 4""")
def raw_trajectories(spark, d):
    """Raw traces and logs made of events, each field said in one of several places, normalised."""
    steps = _steps(spark, d)
    moved = F.col("step") % 3 == 0
    call = F.struct(
        "step", F.when(moved, "").otherwise(F.col("action")).alias("action"), F.when(moved, F.col("action")).alias("action_executed"), F.col("reward").cast("string").alias("reward"),
        F.round("progression", 3).alias("progression"), (F.col("reward") > 45).alias("won"),
    )
    packed = steps.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    rows, fam = ev.trajectories(steps).join(packed, "trajectory_id"), F.col("family_id")
    said = F.to_json(F.struct(F.when(F.col("week") % 2 == 1, F.col("task_slug")).alias("task_or_env_params"), F.when(F.col("week") % 3 == 0, F.col("week").cast("string")).otherwise("x").alias("seed"), F.when(fam % 17 != 4, F.col("calls")).alias("calls")))
    logged = F.to_json(F.struct(
        F.concat(F.lit("log-"), "task_slug").alias("task"), F.when(fam % 2 == 0, F.col("terminal_progression") >= 1).alias("won"), F.lit("high").alias("score"), F.when(fam % 5 != 0, F.round("episode_return", 3)).alias("episode_return"),
    ))
    where = [F.lit("/run").alias("folder"), F.col("trajectory_id").alias("stem")]
    traces = rows.select(F.concat(F.lit("/run/"), "trajectory_id", F.lit("_llm_trace.json")).alias("path"), *where, said.alias("text"))
    logs = rows.where(RAW).select(F.concat(F.lit("/run/"), "trajectory_id", F.lit(".json")).alias("path"), *where, logged.alias("text"))
    found = raw_runs.normalised(traces, logs, "events", "given", "m", 11, root="/run")
    return found.select("trajectory_id", "task_id", "seed", "won", "score", F.array_join(F.transform("steps", lambda x: x["action"]), ">").alias("actions"), F.size("steps").cast("long").alias("n_steps"))


@query("""WITH x AS (SELECT event_id, event_id % 6 AS k, round(value, 2) AS v FROM events) SELECT event_id, CASE WHEN m > 1 THEN m / 100 ELSE m END AS metric FROM (SELECT event_id, CASE k WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN (event_id % 10) / (1.0 + event_id % 4) WHEN 4 THEN 0.25 END AS m FROM x)""", with_steps=False)
def metric_chain(spark, d):
    """The success of summaries that say it in six ways, made of events."""
    rows, n = _table(spark, d, "events"), F.col("event_id")
    v = F.round("value", 2)
    said = F.create_map(
        F.lit(0), F.to_json(F.struct(v.alias("success_rate"), F.lit(1).alias("rate"))), F.lit(1), F.to_json(F.struct(F.lit("none").alias("success_rate"), v.cast("string").alias("rate"))),
        F.lit(2), F.to_json(F.struct(F.struct(F.struct(F.lit(0).alias("mean"), v.alias("value")).alias("success_rate")).alias("metrics"))),
        F.lit(3), F.to_json(F.struct(F.lit("x").alias("rate"), F.lit(0).alias("success_count"), (n % 10).cast("string").alias("num_success"), (n % 4 + 1).alias("total"))),
        F.lit(4), F.lit('{"metrics": {"rate": "0.25", "success_rate": null}}'), F.lit(5), F.lit('{"success_count": 3, "episode_count": 0}'),
    )
    read = F.try_parse_json(said[(n % 6).cast("int")])
    return rows.select("event_id", read.alias("v")).select("event_id", V.share(V.metric(F.col("v"), ["success_rate", "rate"])).alias("metric"))


HISTORY = """WITH ev AS (SELECT conv_id, turn, role = 'user' AS seen, coalesce(text, '') AS said, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'plan ' || turn END AS reason FROM conversations WHERE role IN ('user', 'assistant')),
w AS (SELECT conv_id, turn, seen, list({'seen': seen, 'said': said, 'reason': reason}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS e FROM ev),
p AS (SELECT conv_id, turn, e, list_filter(range(1, len(e) + 1), lambda i: e[i].seen)[-16:] AS shown, list_filter(range(1, len(e) + 1), lambda i: NOT e[i].seen AND e[i].reason IS NOT NULL)[-1:] AS plan FROM w WHERE seen)
SELECT conv_id, turn, len(shown) + len(list_filter(shown, lambda i: i > 1 AND NOT e[greatest(i - 1, 1)].seen)) + 1 AS n_messages, sha256('user: Talk ' || conv_id || array_to_string(list_transform(shown, lambda i:
  CASE WHEN i > 1 AND NOT e[greatest(i - 1, 1)].seen THEN chr(10) || 'assistant: ' || CASE WHEN list_contains(plan, i - 1) THEN 'Previous plan:' || chr(10) || e[greatest(i - 1, 1)].reason ELSE e[greatest(i - 1, 1)].said END ELSE '' END
  || chr(10) || 'user: ' || CASE WHEN i = len(e) THEN 'Current Observation:' || chr(10) || CASE WHEN turn % 3 = 0 THEN 'now ' || turn || chr(10) ELSE '' END ELSE 'Observation:' || chr(10) END || e[i].said), '')) AS prompt_sha256 FROM p"""


@query(HISTORY, with_steps=False)
def prompt_history(spark, d):
    """The prompt at each turn of the user: 16 observations, one reasoning, and what only the current one shows."""
    rows = _table(spark, d, "conversations")
    said = rows.select("conv_id", "turn", F.col("role"), F.col("text").alias("said"))
    seen = said.where("role = 'user'").withColumn("now", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("now "), "turn")))
    done = said.where("role = 'assistant'").withColumn("reasoning", F.when(F.col("turn") % 4 == 1, F.concat(F.lit("plan "), "turn")))
    found = prompts.prompts(prompts.woven(seen, done, "conv_id", "turn"), F.concat(F.lit("Talk "), "conv_id"), "conv_id", "turn")
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return found.select("conv_id", "turn", F.size("messages").cast("long").alias("n_messages"), F.sha2(flat, 256).alias("prompt_sha256"))


SEED = 7


def _order_sql(epoch: int, list_of: str, table: str) -> str:
    """place (an index from 0) and i, where it stands in the epoch's order, of a list: the network walked by recursion.

    The widths are found by the rule of epochs.shape.
    """
    p, name = epochs.PRIME, f"{list_of}{epoch}"
    chain = "SELECT x // b AS l0, x % b AS r0, a, b, n, start"
    for k, (k0, k1, k2) in enumerate(epochs.keys(SEED + epoch + 1, 0, list_of)):
        x = f"l{k} % {p}" if k % 2 else f"r{k} % {p}"
        f = f"(((({x} + {k0}) % {p}) * (({x} + {k1}) % {p})) % {p} * {k2} + ({x} + {k0}) % {p}) % {p}"
        left, right = (f"l{k}", f"(r{k} + {f}) % b") if k % 2 else (f"(l{k} + {f}) % a", f"r{k}")
        chain = f"SELECT {left} AS l{k + 1}, {right} AS r{k + 1}, a, b, n, start FROM ({chain}{' FROM walk_' + name + ' WHERE x < 0 OR x >= n OR fresh' if k == 0 else ''})"
    last = epochs.ROUNDS
    return f"""n_{name} AS (SELECT count(*) AS n FROM {table}),
shape_{name} AS (SELECT n, arg_min(a, (a * b - n, a)) AS a FROM (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, unnest(range(CAST(ceil(sqrt(n)) AS BIGINT), CAST(ceil(sqrt(n)) AS BIGINT) + {epochs.TRIED})) AS a FROM n_{name})) GROUP BY n),
walk_{name}(start, x, fresh, a, b, n) AS (SELECT i, i, true, a, (n + a - 1) // a, n FROM (SELECT unnest(range(n)) AS i, a, n FROM shape_{name})
  UNION ALL SELECT start, l{last} * b + r{last}, false, a, b, n FROM ({chain})),
order_{name} AS (SELECT start, x AS i FROM walk_{name} WHERE NOT fresh AND x < n)"""


EPOCHS = ",\n".join(_order_sql(e, k, t) for e in (0, 1) for k, t in (("a", "supplier"), ("b", "nation")))
EPOCH_ROWS = " UNION ALL ".join(
    f"""SELECT {e} AS epoch, place, s_suppkey, n_nationkey FROM (SELECT unnest(range(greatest((SELECT n FROM n_a{e}), (SELECT n FROM n_b{e})))) AS place)
  JOIN order_a{e} a ON a.start = place % (SELECT n FROM n_a{e}) JOIN order_b{e} b ON b.start = place % (SELECT n FROM n_b{e})
  JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) s ON s.i = a.i JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) m ON m.i = b.i"""
    for e in (0, 1)
)


@query(f"WITH RECURSIVE {EPOCHS} {EPOCH_ROWS}", with_steps=False)
def balanced_epochs(spark, d):
    """Two epochs over suppliers and nations, each list in an order of its own; nations start over."""

    def indexed(name, key):
        rows, n = branching.ranked(_table(spark, d, name).select(key), key, name="i")
        return rows, n

    (a, n), (b, m) = indexed("supplier", "s_suppkey"), indexed("nation", "n_nationkey")
    both = [epochs.balanced_epoch(a, b, (n, m), SEED, e).select(F.lit(e).alias("epoch"), "place", F.col("a_s_suppkey").alias("s_suppkey"), F.col("b_n_nationkey").alias("n_nationkey")) for e in (0, 1)]
    return both[0].unionByName(both[1])


@query("SELECT c_nationkey AS lot, count(*) AS rows, (SELECT count(*) FROM customer) AS all_rows, CAST(sum(length(CAST(c_custkey AS VARCHAR))) AS BIGINT) AS chars FROM customer GROUP BY c_nationkey", with_steps=False)
def committed_lots(spark, d):
    """Customers committed with a folder for each nation, read back through the manifest."""
    folder = f"{new_folder(spark, 'commit')}/customers"
    said = commits.commit(_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("lot")), folder, {"stage": "lots"}, by=["lot"])
    back = commits.committed_rows(spark, folder, "c_custkey bigint, lot bigint", check=True)
    return back.groupBy("lot").agg(F.count(F.lit(1)).alias("rows"), F.lit(said["rows"]).cast("long").alias("all_rows"), F.sum(F.length(F.col("c_custkey").cast("string"))).alias("chars"))


PAIRED = STATES + """, raw AS (SELECT *, first_value(task_slug) OVER (PARTITION BY family_id, divergence_step, state_key ORDER BY trajectory_kind DESC, task_slug) AS task FROM sc), sgood AS (SELECT * FROM raw WHERE is_win AND quality_score <= 1),
wl AS (SELECT c.task, c.family_id, c.divergence_step, c.state_key, c.trajectory_id AS won, r.trajectory_id AS lost FROM sgood c JOIN raw r USING (family_id, divergence_step, state_key) WHERE NOT r.is_win AND NOT (c.trajectory_kind = 'base' AND r.trajectory_kind = 'base')),
sup AS (SELECT * FROM sgood g WHERE EXISTS (SELECT 1 FROM wl WHERE wl.family_id = g.family_id AND wl.divergence_step = g.divergence_step AND wl.state_key = g.state_key AND won = g.trajectory_id)),
ps AS (SELECT b.task, CASE WHEN a.post_divergence_call_count < b.post_divergence_call_count THEN a.trajectory_id ELSE b.trajectory_id END AS won, CASE WHEN a.post_divergence_call_count < b.post_divergence_call_count THEN b.trajectory_id ELSE a.trajectory_id END AS lost
  FROM sgood b JOIN sgood a USING (family_id, divergence_step, state_key) WHERE b.trajectory_kind = 'base' AND a.trajectory_kind = 'alt')"""
KEY3 = "(family_id, divergence_step, state_key)"


def _ww(table: str) -> str:
    """Pairs of wins of a state."""
    return f"SELECT a.task, family_id, divergence_step, state_key FROM {table} a JOIN {table} b USING (family_id, divergence_step, state_key) WHERE (a.trajectory_kind = 'alt', a.trajectory_id) < (b.trajectory_kind = 'alt', b.trajectory_id) AND NOT (a.trajectory_kind = 'base' AND b.trajectory_kind = 'base')"


def _by_task(**counters: tuple[str, str]) -> str:
    """A select of counters per task and over all: of each, the table (with task) and the aggregate."""
    joins = "".join(f" LEFT JOIN (SELECT coalesce(task, 'all') AS task, {what} AS v FROM {table} GROUP BY ROLLUP (task)) AS j{k} ON j{k}.task = t.task" for k, (table, what) in enumerate(counters.values()))
    return f"SELECT t.task AS task_slug, {', '.join(f'coalesce(j{k}.v, 0) AS {name}' for k, name in enumerate(counters))} FROM (SELECT DISTINCT task FROM raw UNION ALL SELECT 'all') t{joins}"


ALL, STATES_OF, WON, LOST = "count(*)", f"count(DISTINCT {KEY3})", "count(*) FILTER (is_win)", "count(*) FILTER (NOT is_win)"
FILTERED = _by_task(
    state_group_count=("raw", STATES_OF), raw_win_candidates=("raw", WON), quality_filtered_win_candidates=("sgood", ALL), support_filtered_win_candidates=("sup", ALL), lose_candidates=("raw", LOST),
    win_lose_rows=("(SELECT task FROM wl UNION ALL SELECT task FROM ps)", ALL), observed_win_lose_rows=("wl", ALL), pseudo_win_lose_rows=("ps", ALL), win_win_rows=(f"({_ww('sup')})", ALL),
    unique_win_trajectory_count=("(SELECT task, won FROM wl UNION ALL SELECT task, won FROM ps UNION ALL SELECT task, lost FROM ps)", "count(DISTINCT won)"), unique_lose_trajectory_count=("wl", "count(DISTINCT lost)"),
    unique_rejected_trajectory_count=("(SELECT task, lost FROM wl UNION ALL SELECT task, lost FROM ps)", "count(DISTINCT lost)"),
)
BALANCED = _by_task(
    state_group_count=("raw", STATES_OF), raw_win_candidates=("raw", WON), quality_filtered_win_candidates=("sgood", ALL), lose_candidates=("raw", LOST), win_lose_eligible_wins=("sup", ALL),
    win_win_eligible_wins=(f"(SELECT g.task FROM sgood g JOIN (SELECT DISTINCT family_id, divergence_step, state_key FROM ({_ww('sgood')})) USING (family_id, divergence_step, state_key))", ALL), win_lose_rows=("wl", ALL), win_win_rows=(f"({_ww('sgood')})", ALL), positive_rows=("sgood", ALL),
    win_lose_state_count=("wl", STATES_OF), win_win_state_count=(f"({_ww('sgood')})", STATES_OF), positive_state_count=("sgood", STATES_OF), positive_eligible_wins=("sgood", ALL),
    unique_win_trajectory_count=("sgood", "count(DISTINCT trajectory_id)"), unique_lose_trajectory_count=("wl", "count(DISTINCT lost)"), unique_positive_trajectory_count=("sgood", "count(DISTINCT trajectory_id)"),
)
SELECTED = _by_task(
    state_group_count=("raw", STATES_OF), eligible_state_group_count=("every", STATES_OF), raw_win_candidates=("raw", WON), raw_lose_candidates=("raw", LOST), observed_pair_candidate_count=("every", ALL), pseudo_pair_candidate_count=("raw", "0"),
    selected_observed_row_count=("every", "count(*) FILTER (k = 1)"), selected_pseudo_row_count=("raw", "0"), output_rows=("every", "count(*) FILTER (k = 1)"),
    unique_chosen_trajectory_count=("every", "count(DISTINCT won) FILTER (k = 1)"), unique_rejected_trajectory_count=("every", "count(DISTINCT lost) FILTER (k = 1)"),
)


@query(f"+{PAIRED} {FILTERED}")
def filtered_statistics(spark, d):
    found = statistics.filtered_statistics(_at_states(spark, d), MOST_REPEATS, pseudo=True)
    return found.withColumn("task_slug", F.coalesce("task_slug", F.lit("all")))


@query(f"+{PAIRED} {BALANCED}")
def balanced_statistics(spark, d):
    found = statistics.balanced_statistics(_at_states(spark, d), MOST_REPEATS)
    return found.withColumn("task_slug", F.coalesce("task_slug", F.lit("all")))


@query(f"""+{PAIRED}, freq AS (SELECT task_slug, action_text, count(*) AS c FROM sc GROUP BY ALL), scored AS (SELECT r.*, 1.0 / c AS score FROM raw r JOIN freq USING (task_slug, action_text)),
every AS (SELECT c.task, family_id, divergence_step, state_key, c.trajectory_id AS won, r.trajectory_id AS lost, row_number() OVER (PARTITION BY family_id, divergence_step, state_key ORDER BY c.score DESC, r.score, c.trajectory_kind = 'alt', c.trajectory_id, r.trajectory_kind = 'alt', r.trajectory_id) AS k
  FROM scored c JOIN scored r USING (family_id, divergence_step, state_key) WHERE c.is_win AND NOT r.is_win AND NOT (c.trajectory_kind = 'base' AND r.trajectory_kind = 'base'))
{SELECTED}""")
def divpo_statistics(spark, d):
    rows = _at_states(spark, d)
    scored = divpo.with_diversity(rows)
    taken = divpo.select(pairs.win_lose(divpo.leading(scored.where("is_win"), True), divpo.leading(scored.where("not is_win"), False)))
    return statistics.divpo_statistics(rows, taken).withColumn("task_slug", F.coalesce("task_slug", F.lit("all")))


SHOPS = """ep AS (SELECT trajectory_id, task_slug AS suite, family_id % 3 AS seed, greatest(terminal_progression, terminal_reward / 100) >= 0.5 AS ok, n_steps % 5 = 0 AS aborted, CASE WHEN n_steps % 4 <> 1 THEN action_text END AS way,
  CASE WHEN n_steps % 6 = 2 THEN '' ELSE action_text END AS sig FROM traj), e AS (SELECT *, ok AND NOT aborted AS won FROM ep),
c AS (SELECT suite, seed, way, count(*) FILTER (won) AS c, count(*) FILTER (NOT aborted AND way IS NOT NULL) AS a FROM e GROUP BY ALL),
h AS (SELECT suite, seed, sum(c) AS n, count(*) FILTER (c > 0) AS ways, max(c) AS top, count(*) FILTER (a > 0) AS every, sum(CASE WHEN c > 0 THEN c * ln(c) ELSE 0 END) AS spread FROM c GROUP BY suite, seed),
t AS (SELECT suite, seed, count(*) AS total, count(*) FILTER (NOT aborted) AS alive, count(*) FILTER (won) AS wins, count(*) FILTER (sig = '') AS missing, count(*) FILTER (sig = '' AND won) AS missing_won, count(*) FILTER (way IS NULL) AS undefined FROM e GROUP BY suite, seed),
r AS (SELECT *, CASE WHEN wins > 0 THEN exp(ln(wins) - spread / wins) ELSE 0.0 END AS eff FROM t JOIN h USING (suite, seed))"""


def _episodes(spark, d):
    rows, n = ev.trajectories(_steps(spark, d)), F.col("n_steps")
    return rows.select(
        "trajectory_id", F.col("task_slug").alias("suite"), (F.col("family_id") % 3).alias("seed"), outcomes.by_score(F.col("terminal_progression"), F.col("terminal_reward") / 100, 0.5).alias("is_success"), (n % 5 == 0).alias("aborted"),
        F.when(n % 4 != 1, F.col("action_text")).alias("strategy"), F.when(n % 6 == 2, "").otherwise(F.col("action_text")).alias("signature"),
    )


@query(f"""+{SHOPS} SELECT suite, seed, total AS trajectory_count, alive AS non_aborted_count, total - alive AS aborted_count, wins AS success_count, round(wins / total, 9) AS success_at_k, round(CASE WHEN alive > 0 THEN wins / alive ELSE 0 END, 9) AS success_at_non_aborted, ways AS unique_success_strategy_count,
  round(eff, 7) AS entropy_effective_success_strategy_count, round(eff / total, 7) AS h_esd, round(ways / total, 9) AS esd, round(CASE WHEN alive > 0 THEN ways / alive ELSE 0 END, 9) AS esd_non_aborted, round(CASE WHEN wins > 0 THEN ways / wins ELSE 0 END, 9) AS wsd, round(CASE WHEN wins > 0 THEN eff / wins ELSE 0 END, 7) AS h_wsd,
  round(CASE WHEN wins > 0 THEN top / wins ELSE 0 END, 9) AS top1_share, every AS unique_total_strategy_count, round(every / total, 9) AS total_div, round(CASE WHEN alive > 0 THEN every / alive ELSE 0 END, 9) AS total_div_non_aborted, missing AS missing_signature_count, missing_won AS missing_success_signature_count, CAST(undefined AS BIGINT) AS undefined_strategy_key_count FROM r""")
def run_reports(spark, d):
    found = reports.run_report(_episodes(spark, d), ["suite", "seed"])
    digits = {"entropy_effective_success_strategy_count": 7, "h_esd": 7, "h_wsd": 7} | dict.fromkeys(["success_at_k", "success_at_non_aborted", "esd", "esd_non_aborted", "wsd", "top1_share", "total_div", "total_div_non_aborted"], 9)
    return found.withColumns({c: F.round(c, k) for c, k in digits.items()})


@query(f"""+{SHOPS}, m AS (SELECT suite, seed, unnest(['esd', 'h_esd', 'wsd', 'h_wsd']) AS metric, unnest([ways / total, eff / total, CASE WHEN wins > 0 THEN ways / wins ELSE 0 END, CASE WHEN wins > 0 THEN eff / wins ELSE 0 END]) AS v FROM r)
SELECT suite, metric, 'ok' AS status, round(avg(v), 7) AS mean, round(stddev_pop(v), 6) AS std, string_agg(CAST(CAST(round(v * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY seed) AS per_seed FROM m GROUP BY suite, metric""")
def seed_reports(spark, d):
    found = reports.seed_report(_episodes(spark, d), ["suite"])
    each = F.array_join(F.transform("per_seed", lambda x: F.round(x * 100000).cast("long").cast("string")), ",")
    return found.select("suite", "metric", "status", F.round("mean", 7).alias("mean"), F.round("std", 6).alias("std"), each.alias("per_seed"))


@query("SELECT conv_id, turn, CAST(length(coalesce(text, 'none')) AS DOUBLE) AS score, 0 AS scored_again FROM conversations", with_steps=False)
def cached_scores(spark, d):
    """Texts scored through the table of scores, twice: the second run finds all that it needs there."""
    rows = _table(spark, d, "conversations").select("conv_id", "turn", "text")
    folder = f"{new_folder(spark, 'scores')}/table"
    seen = spark.sparkContext.accumulator(0)

    def length(keys):
        nonlocal seen
        n = keys.count()
        seen.add(n)
        return keys.withColumn("score", F.length(F.coalesce("text", F.lit("none"))).cast("double"))

    scored_once(rows, length, ["text"], folder, "length-1")
    before = seen.value
    found = scored_once(rows, length, ["text"], folder, "length-1")
    return found.select("conv_id", "turn", "score", F.lit(seen.value - before).alias("scored_again"))


@query(f"+{BRANCH} SELECT task_slug, base_traj_id, divergence_step, alt_index, arg_max(coalesce(status, ''), ord) AS status, max(ord) AS ord FROM br GROUP BY ALL")
def stream_upserts(spark, d):
    """The branch ledger kept in buckets from a stream of files; the same rows as one merge of all records."""
    from .streaming.buckets import held_rows, keep_buckets
    from .streaming.ledger import records

    root = new_folder(spark, "buckets")
    rows = _branches(spark, d).select("task_slug", "base_traj_id", "divergence_step", F.col("alt_index"), F.coalesce("status", F.lit("")).alias("status"), "ord")
    rows.write.json(f"{root}/in")
    keep_buckets(records(spark, f"{root}/in", rows.schema, 2), f"{root}/ledger", f"{root}/checkpoint", buckets=8).awaitTermination()
    return held_rows(spark, f"{root}/ledger")


@query("SELECT count(*) AS plan_rows, (SELECT count(*) FROM orders) AS source_rows, count(DISTINCT l_orderkey) AS distinct_rows, round(count(*) / (SELECT count(*) FROM orders), 9) AS resample_ratio, round(count(*) / count(DISTINCT l_orderkey), 9) AS reuse_ratio, (SELECT string_agg(m || '=' || n, ',' ORDER BY m) FROM (SELECT coalesce(nullif(l_shipmode, ''), 'unknown') AS m, count(*) AS n FROM lineitem GROUP BY ALL)) AS modes FROM lineitem".replace("l_shipmode", "l_returnflag"), with_steps=False)
def plan_reports(spark, d):
    """Order lines as a plan over orders, each line's flag its mode."""
    plan = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_idx"), F.col("l_returnflag").alias("mode"))
    found = sft.plan_report(plan, _table(spark, d, "orders").count())
    modes = F.array_join(F.array_sort(F.transform(F.map_entries("mode_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return found.select("plan_rows", "source_rows", "distinct_rows", F.round("resample_ratio", 9).alias("resample_ratio"), F.round("reuse_ratio", 9).alias("reuse_ratio"), modes.alias("modes"))


@query("""+e AS (SELECT trajectory_id, task_slug, n_steps % 5 <> 0 AS ok, n_steps % 5 <> 0 AND terminal_progression >= 0.4 AS won, (SELECT string_agg(action, '>' ORDER BY step) FROM step s WHERE s.trajectory_id = t.trajectory_id) AS way FROM traj t),
c AS (SELECT task_slug, way, count(*) AS c FROM e WHERE won GROUP BY ALL), h AS (SELECT task_slug, count(*) AS ways, exp(ln(sum(c)) - sum(c * ln(c)) / sum(c)) AS hill FROM c GROUP BY task_slug)
SELECT e.task_slug, count(*) AS episode_count, count(*) FILTER (ok) AS valid_episode_count, count(*) FILTER (won) AS success_count, coalesce(any_value(ways), 0) AS raw_unique, round(coalesce(any_value(hill), 0), 7) AS raw_hill, coalesce(any_value(ways), 0) AS effective_unique,
  round(coalesce(any_value(ways), 0) / greatest(count(*) FILTER (ok), 1), 9) AS effective_esd, round(coalesce(any_value(hill), 0) / greatest(count(*) FILTER (won), 1), 7) AS effective_h_wsd FROM e LEFT JOIN h USING (task_slug) GROUP BY e.task_slug""")
def run_diversity(spark, d):
    """Diversity of runs from episodes and steps, by the rule that leaves every action."""
    steps = _steps(spark, d)
    n = F.col("n_steps")
    eps = ev.trajectories(steps).select("trajectory_id", "task_slug", (n % 5 != 0).alias("is_valid"), (F.col("terminal_progression") >= 0.4).alias("is_success"))
    found = diversity.run_diversity(eps, steps, ["task_slug"], "none")
    return found.select("task_slug", "episode_count", "valid_episode_count", "success_count", "raw_unique", F.round("raw_hill", 7).alias("raw_hill"), "effective_unique", F.round("effective_esd", 9).alias("effective_esd"), F.round("effective_h_wsd", 7).alias("effective_h_wsd"))


@query("SELECT event_id // 100 AS \"window\", max(event_id) AS step, round(avg(value), 9) AS value FROM events GROUP BY 1", with_steps=False)
def log_windows(spark, d):
    rows = _table(spark, d, "events").select(F.col("event_id").alias("step"), "value")
    return targets.window_means(rows, ["value"], 100).withColumn("value", F.round("value", 9))


@query("SELECT page_id, sha256(coalesce(url, '') || CASE WHEN page_id % 4 = 3 THEN '' ELSE chr(10) || chr(10) || 'Available actions for this state:' || chr(10) || CASE page_id % 4 WHEN 0 THEN '- search[x]' WHEN 1 THEN '- click[back to search]' || chr(10) || '- click[' || page_id || ']' ELSE '- click[' || page_id || ']' END || CASE page_id % 4 WHEN 0 THEN chr(10) || chr(10) || 'This is the search page. Use one listed search[...] or a concise custom search[...] from the shopping instruction. Do not include words like ''instruction'' or ''find'' in the query.' ELSE chr(10) || chr(10) || 'Choose exactly one click[...] action from this list. Do not output search[...].' || CASE WHEN page_id % 4 = 1 THEN chr(10) || 'Search is not available on this page; choose click[back to search] before a new search.' ELSE '' END END END) AS prompt_sha256 FROM pages", with_steps=False)
def page_prompts(spark, d):
    """Pages as a shop's observations, with the actions that each kind of page has."""
    rows, n = _table(spark, d, "pages"), F.col("page_id")
    own = F.concat(F.lit("click["), n.cast("string"), F.lit("]"))
    available = F.when(n % 4 == 0, F.array(F.lit("search[x]"))).when(n % 4 == 1, F.array(F.lit("click[back to search]"), own)).when(n % 4 == 2, F.array(own))
    return rows.select("page_id", F.sha2(text.page_prompt(F.col("url"), available), 256).alias("prompt_sha256"))


@query(f"""WITH x AS (SELECT event_id % {LOTS} AS lot, event_id % 12 AS k, row_number() OVER (PARTITION BY event_id % {LOTS} ORDER BY event_id) AS line FROM events)
SELECT lot, line, CASE k WHEN 3 THEN 'missing required fields: rejected' WHEN 5 THEN 'pair_weight must be above 0' WHEN 7 THEN 'chosen.action_text must be a text that isn''t empty' WHEN 9 THEN 'pair_type tie is not win_lose or win_win' WHEN 10 THEN 'chosen_target_prob must be in [0, 1]' ELSE 'invalid JSON' END AS reason FROM x WHERE k IN (3, 5, 7, 9, 10, 11)""", with_steps=False)
def training_faults(spark, d):
    """Files of balanced pairs made of events, some lines of which break a rule, and the faults that a trainer is told."""
    k = F.col("event_id") % 12
    side = lambda text: F.struct(text.alias("action_text"), F.lit(True).alias("success"))
    row = F.to_json(F.struct(
        F.when(k == 9, "tie").otherwise("win_lose").alias("pair_type"), F.col("event_type").alias("prompt"), side(F.when(k == 7, " ").otherwise("up")).alias("chosen"), F.when(k != 3, side(F.lit("down"))).alias("rejected"),
        F.when(k == 5, "0").otherwise("1.5").alias("pair_weight"), F.when(k == 10, 1.01).otherwise(1.0).alias("chosen_target_prob"),
    ))
    rows = _table(spark, d, "events").select((F.col("event_id") % LOTS).alias("lot"), "event_id", F.when(k == 11, F.substring(row, 1, 30)).otherwise(row).alias("value"))
    folder = f"{new_folder(spark, 'pairs')}/files"
    rows.repartition(LOTS, "lot").sortWithinPartitions("lot", "event_id").select("lot", "value").write.partitionBy("lot").text(folder)
    found = training_files.faults(spark, folder, "balanced_pair")
    reason = F.when(F.col("reason").startswith("invalid JSON"), "invalid JSON").otherwise(F.col("reason"))
    return found.select(F.regexp_extract("file", r"lot=(-?\d+)", 1).cast("long").alias("lot"), F.col("line").cast("long").alias("line"), reason.alias("reason"))
