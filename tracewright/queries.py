"""The library's operators over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import casts, outcomes, text
from .functions import python_text as pt
from .operators import artifacts, bases, branching, calls, checks, divpo, diversity, episodes, pairs, planning, records, resume, sft, shopping, targets, trace_rows
from .operators import candidates as cand
from .operators.zip import balanced_zip as zip_rows
from .plans import pair_datasets
from .plans.stages import PairConfig
from .sources import event_view as ev
from .sources.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MOST_REPEATS = 1

STEP = """ev AS (SELECT event_id, user_id AS family_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS week, ts, event_type, value FROM events),
seq AS (SELECT *, family_id || '-w' || week AS trajectory_id, row_number() OVER w - 1 AS step, lag(value) OVER w AS before, lead(event_id) OVER w IS NULL AS done FROM ev WINDOW w AS (PARTITION BY family_id, week ORDER BY ts, event_id)),
step AS (SELECT family_id, trajectory_id, CASE WHEN week = 0 THEN 'base' ELSE 'alt' END AS trajectory_kind, 't' || (family_id % 4) AS task_slug, week, step, event_id,
  CASE event_type WHEN 'signup' THEN 'idle' WHEN 'click' THEN 'up' WHEN 'view' THEN 'down' WHEN 'purchase' THEN 'right' ELSE 'left' END AS action,
  CASE event_type WHEN 'click' THEN 'turn left' WHEN 'view' THEN 'turn right' ELSE event_type END AS turn_action,
  value AS reward, value / 50.0 AS progression, CAST(floor(coalesce(before, 0) / 25) AS BIGINT) AS obs_pre, CAST(floor(value / 25) AS BIGINT) AS obs_post, done FROM seq),
traj AS (SELECT family_id, trajectory_id, trajectory_kind, task_slug, week, count(*) AS n_steps, sum(reward) AS episode_return, arg_min(action, step) AS action_text,
  arg_max(reward, step) AS terminal_reward, arg_max(progression, step) AS terminal_progression, -(arg_min(event_id, step) % 97) / 10.0 AS ref_logprob FROM step GROUP BY ALL),
isl AS (SELECT trajectory_id, step, CASE WHEN lag(obs_pre) OVER w = obs_pre AND lag(action) OVER w = action THEN 0 ELSE 1 END AS fresh FROM step WINDOW w AS (PARTITION BY trajectory_id ORDER BY step)),
run AS (SELECT trajectory_id, max(n) AS max_run FROM (SELECT trajectory_id, r, count(*) AS n FROM (SELECT trajectory_id, sum(fresh) OVER (PARTITION BY trajectory_id ORDER BY step) AS r FROM isl) GROUP BY ALL) GROUP BY trajectory_id),
cand AS (SELECT family_id, trajectory_id, trajectory_kind, 0 AS divergence_step, CAST(family_id AS VARCHAR) AS state_key, task_slug, action_text, terminal_progression, terminal_reward, max_run AS quality_score,
  terminal_progression >= 1 AS is_win, n_steps AS post_divergence_call_count, ref_logprob FROM traj JOIN run USING (trajectory_id)),
good AS (SELECT * FROM cand WHERE is_win AND quality_score <= 1)"""


def query(sql: str | None = None, with_steps: bool = True, recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' * recursive}{STEP}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}" if with_steps else sql)
        return f

    return add


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return ev.steps(spark, d)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    steps = _steps(spark, d)
    return cand.candidates(ev.trajectories(steps), cand.longest_repeat(steps), outcomes.by_progression(F.col("terminal_progression")))


def _wins(spark: SparkSession, d: str) -> DataFrame:
    return pairs.good_wins(_candidates(spark, d), MOST_REPEATS)


@query("SELECT family_id, trajectory_id, trajectory_kind, task_slug, n_steps, round(episode_return, 6) AS episode_return, action_text, terminal_reward, terminal_progression >= 1 AS is_win FROM traj")
def traj_summary(spark, d):
    rows = ev.trajectories(_steps(spark, d))
    return rows.select("family_id", "trajectory_id", "trajectory_kind", "task_slug", "n_steps", F.round("episode_return", 6).alias("episode_return"), "action_text", "terminal_reward", outcomes.by_progression(F.col("terminal_progression")).alias("is_win"))


@query("""SELECT trajectory_id, terminal_progression >= 1 AS by_progression, greatest(terminal_progression, terminal_reward / 100) >= 0.9 AS by_score,
  terminal_progression >= 1 OR terminal_reward > 40 AS by_finish,
  CASE WHEN task_slug = 't0' THEN terminal_progression >= 5.0 / 17 - 1e-9 WHEN task_slug = 't1' THEN terminal_progression >= 1 - 1e-9 ELSE terminal_progression >= 1 OR terminal_reward > 40 END AS for_training,
  coalesce(terminal_progression >= 1, false) AS of_log, NOT (week = 3) AS is_valid FROM traj""")
def success_rules(spark, d):
    rows = ev.trajectories(_steps(spark, d))
    slug = F.when(F.col("task_slug") == "t0", outcomes.COOKING).when(F.col("task_slug") == "t1", outcomes.SIMPLE_GAMES[0]).otherwise("other")
    p, r, none = F.col("terminal_progression"), F.col("terminal_reward"), F.lit(None)
    end = (F.lit(None).cast("boolean"), p, F.lit(True), r - 40)
    text_none = none.cast("string")
    return rows.select(
        "trajectory_id", outcomes.by_progression(p).alias("by_progression"), outcomes.by_score(p, r / 100).alias("by_score"), outcomes.by_finish(*end).alias("by_finish"),
        outcomes.for_training(slug, *end).alias("for_training"), outcomes.of_log(text_none, text_none, p, text_none, none.cast("double"), F.col("episode_return")).alias("of_log"),
        outcomes.is_valid(text_none, text_none, text_none, F.when(F.col("week") == 3, "Aborted: limit")).alias("is_valid"),
    )


@query("SELECT trajectory_id, max_run FROM run")
def max_same_run(spark, d):
    return cand.longest_repeat(_steps(spark, d))


BRANCH = """br AS (SELECT trajectory_id AS alt_traj_id, family_id || '-w0' AS base_traj_id, family_id, task_slug, week AS alt_index, n_steps % 4 AS divergence_step,
  CASE WHEN family_id % 11 = 0 THEN '' ELSE CAST(family_id AS VARCHAR) END AS state_key, n_steps AS ord,
  CASE WHEN n_steps % 7 = 0 THEN 'retry_exhausted' WHEN n_steps % 7 = 1 THEN NULL WHEN n_steps % 7 = 2 THEN 'replay_mismatch' ELSE 'generated' END AS status,
  n_steps % 5 <> 0 AS replay_success, n_steps % 3 <> 0 AS files_exist FROM traj WHERE trajectory_kind = 'alt')"""


def _branches(spark, d):
    rows = ev.trajectories(_steps(spark, d)).where("trajectory_kind = 'alt'")
    n = F.col("n_steps")
    status = F.when(n % 7 == 0, "retry_exhausted").when(n % 7 == 2, "replay_mismatch").when(n % 7 != 1, "generated")
    return rows.select(
        F.col("trajectory_id").alias("alt_traj_id"), F.concat("family_id", F.lit("-w0")).alias("base_traj_id"), "family_id", "task_slug", F.col("week").alias("alt_index"), (n % 4).alias("divergence_step"),
        F.when(F.col("family_id") % 11 == 0, "").otherwise(F.col("family_id").cast("string")).alias("state_key"), n.alias("ord"), status.alias("status"), (n % 5 != 0).alias("replay_success"), (n % 3 != 0).alias("files_exist"),
    )


@query(f"""+{BRANCH} SELECT alt_traj_id, coalesce(status, '') = 'generated' AND replay_success AND divergence_step >= 0 AND state_key <> '' AS in_builder, coalesce(status, 'generated') = 'generated' AS in_artifacts
  FROM br WHERE coalesce(status, 'generated') = 'generated'""")
def branch_eligible(spark, d):
    rows = _branches(spark, d)
    built = cand.eligible_branches(rows).select("alt_traj_id", F.lit(True).alias("in_builder"))
    taken = cand.normal_branches(rows).select("alt_traj_id", F.lit(True).alias("in_artifacts"))
    return taken.join(built, "alt_traj_id", "left").select("alt_traj_id", F.coalesce("in_builder", F.lit(False)).alias("in_builder"), "in_artifacts")


@query("SELECT family_id, trajectory_id, trajectory_kind, divergence_step, state_key, task_slug, action_text, terminal_reward, quality_score, is_win, post_divergence_call_count FROM cand")
def candidates(spark, d):
    return _candidates(spark, d).drop("terminal_progression", "ref_logprob")


STATES = BRANCH + """, st AS (SELECT alt_traj_id, base_traj_id, least(divergence_step, b.n_steps - 1, ord - 1) AS d, state_key || '/' || (alt_index % 2) AS state_key
  FROM br JOIN traj b ON b.trajectory_id = base_traj_id WHERE status = 'generated' AND replay_success AND state_key <> ''),
placed AS (SELECT DISTINCT base_traj_id AS family_id, d, state_key, base_traj_id AS trajectory_id, 'base' AS trajectory_kind FROM st UNION ALL SELECT base_traj_id, d, state_key, alt_traj_id, 'alt' FROM st),
sc AS (SELECT p.family_id, p.d AS divergence_step, p.state_key, p.trajectory_id, p.trajectory_kind, t.task_slug, s.action AS action_text, t.terminal_reward, max_run AS quality_score, t.terminal_progression >= 1 AS is_win, t.n_steps - p.d AS post_divergence_call_count
  FROM placed p JOIN traj t ON t.trajectory_id = p.trajectory_id JOIN run ON run.trajectory_id = p.trajectory_id JOIN step s ON s.trajectory_id = p.trajectory_id AND s.step = p.d),
sg AS (SELECT * FROM sc WHERE is_win AND quality_score <= 1)"""


def _at_states(spark, d):
    steps = _steps(spark, d)
    size = ev.trajectories(steps).where("trajectory_kind = 'base'").select(F.col("trajectory_id").alias("base_traj_id"), F.col("n_steps").alias("base_steps"))
    index = _branches(spark, d).join(size, "base_traj_id").withColumns({
        "divergence_step": F.least("divergence_step", F.col("base_steps") - 1, F.col("ord") - 1).cast("int"), "output_trace": F.col("alt_traj_id"),
        "state_key": F.when(F.col("state_key") != "", F.concat("state_key", F.lit("/"), (F.col("alt_index") % 2).cast("string"))).otherwise(""),
    })
    traces = ev.traces(steps)
    return cand.at_states(index, traces.where("trajectory_kind = 'base'"), traces.where("trajectory_kind = 'alt'"), outcomes.by_progression(F.col("terminal_progression")))


@query(f"+{STATES} SELECT * FROM sc")
def branch_candidates(spark, d):
    return _at_states(spark, d).select(*cand.STATE, "trajectory_id", "trajectory_kind", "task_slug", "action_text", "terminal_reward", "quality_score", "is_win", "post_divergence_call_count")


STATE_PAIR = "family_id, divergence_step, state_key, c.trajectory_id AS chosen_trajectory_id, r.trajectory_id AS rejected_trajectory_id, c.action_text AS chosen_action_text, r.action_text AS rejected_action_text"


def _state_pair(rows, kind):
    return pairs.pair_rows(rows, kind).select(*cand.STATE, "chosen_trajectory_id", "rejected_trajectory_id", "chosen_action_text", "rejected_action_text")


@query(f"+{STATES} SELECT {STATE_PAIR} FROM sg c JOIN sc r USING (family_id, divergence_step, state_key) WHERE NOT r.is_win AND NOT (c.trajectory_kind = 'base' AND r.trajectory_kind = 'base')")
def branch_pairs_win_lose(spark, d):
    rows = _at_states(spark, d)
    return _state_pair(pairs.win_lose(pairs.good_wins(rows, MOST_REPEATS), rows.where("not is_win")), "win_lose")


@query(f"+{STATES} SELECT {STATE_PAIR} FROM sg c JOIN sg r USING (family_id, divergence_step, state_key) WHERE (CASE WHEN c.trajectory_kind = 'base' THEN 0 ELSE 1 END, c.trajectory_id) < (CASE WHEN r.trajectory_kind = 'base' THEN 0 ELSE 1 END, r.trajectory_id)")
def branch_pairs_win_win(spark, d):
    return _state_pair(pairs.win_win(pairs.good_wins(_at_states(spark, d), MOST_REPEATS)), "win_win")


PAIR_OUT = "c.task_slug, c.family_id, c.state_key, CASE WHEN 'base' IN (c.trajectory_kind, r.trajectory_kind) THEN 'base-alt' ELSE 'alt-alt' END AS pair_origin, c.trajectory_id AS chosen_trajectory_id, r.trajectory_id AS rejected_trajectory_id, c.action_text AS chosen_action_text, r.action_text AS rejected_action_text"


def _pair_out(rows, kind):
    return pairs.pair_rows(rows, kind).select("task_slug", "family_id", "state_key", "pair_origin", "chosen_trajectory_id", "rejected_trajectory_id", "chosen_action_text", "rejected_action_text")


@query(f"SELECT {PAIR_OUT} FROM good c JOIN cand r USING (family_id, state_key) WHERE NOT r.is_win AND NOT (c.trajectory_kind = 'base' AND r.trajectory_kind = 'base')".replace("c.family_id, c.state_key", "family_id, state_key"))
def pairs_win_lose(spark, d):
    rows = _candidates(spark, d)
    return _pair_out(pairs.win_lose(pairs.good_wins(rows, MOST_REPEATS), rows.where("not is_win")), "win_lose")


@query(f"SELECT {PAIR_OUT} FROM good c JOIN good r USING (family_id, state_key) WHERE (CASE WHEN c.trajectory_kind = 'base' THEN 0 ELSE 1 END, c.trajectory_id) < (CASE WHEN r.trajectory_kind = 'base' THEN 0 ELSE 1 END, r.trajectory_id)".replace("c.family_id, c.state_key", "family_id, state_key"))
def pairs_win_win(spark, d):
    return _pair_out(pairs.win_win(_wins(spark, d)), "win_win")


PSEUDO = """+ps AS (SELECT b.task_slug, b.family_id, b.state_key, a.post_divergence_call_count < b.post_divergence_call_count AS turned, b.trajectory_id AS bi, a.trajectory_id AS ai, b.action_text AS ba, a.action_text AS aa, b.post_divergence_call_count AS bn, a.post_divergence_call_count AS an
  FROM good b JOIN good a ON a.family_id = b.family_id WHERE b.trajectory_kind = 'base' AND a.trajectory_kind = 'alt')"""


@query(PSEUDO + " SELECT task_slug, family_id, state_key, 'base-alt' AS pair_origin, CASE WHEN turned THEN ai ELSE bi END AS chosen_trajectory_id, CASE WHEN turned THEN bi ELSE ai END AS rejected_trajectory_id, CASE WHEN turned THEN aa ELSE ba END AS chosen_action_text, CASE WHEN turned THEN ba ELSE aa END AS rejected_action_text FROM ps")
def pairs_pseudo(spark, d):
    return _pair_out(pairs.base_and_alternative(_wins(spark, d)), "win_lose")


@query("SELECT trajectory_id, trajectory_kind FROM good g WHERE EXISTS (SELECT 1 FROM cand l WHERE l.family_id = g.family_id AND NOT l.is_win AND NOT (g.trajectory_kind = 'base' AND l.trajectory_kind = 'base'))")
def support_filter(spark, d):
    rows = _candidates(spark, d)
    return pairs.supported(pairs.good_wins(rows, MOST_REPEATS), rows.where("not is_win")).select("trajectory_id", "trajectory_kind")


@query("""SELECT task_slug, count(*) AS candidates, count(*) FILTER (is_win) AS raw_win_candidates, count(*) FILTER (is_win AND quality_score <= 1) AS quality_filtered_win_candidates, count(*) FILTER (NOT is_win) AS lose_candidates,
  count(DISTINCT trajectory_id) FILTER (is_win) AS unique_win_trajectory_count, count(DISTINCT trajectory_id) FILTER (NOT is_win) AS unique_lose_trajectory_count, count(DISTINCT family_id) AS state_group_count FROM cand GROUP BY ROLLUP (task_slug)""")
def task_stats_rollup(spark, d):
    return pairs.task_stats(_candidates(spark, d), MOST_REPEATS)


WL = "+wl AS (SELECT c.family_id, c.trajectory_id AS chosen_trajectory_id, r.trajectory_id AS rejected_trajectory_id FROM good c JOIN cand r ON c.family_id = r.family_id WHERE NOT r.is_win AND NOT (c.trajectory_kind = 'base' AND r.trajectory_kind = 'base'))"


@query(WL + " SELECT family_id, chosen_trajectory_id, rejected_trajectory_id, round((SELECT count(*) FROM wl) / ((SELECT count(DISTINCT family_id) FROM wl) * count(*) OVER (PARTITION BY family_id)), 9) AS pair_weight FROM wl")
def pair_weights(spark, d):
    rows = pair_datasets.win_lose_rows(_candidates(spark, d), PairConfig(most_repeats=MOST_REPEATS))
    return rows.select("family_id", "chosen_trajectory_id", "rejected_trajectory_id", F.round("pair_weight", 9).alias("pair_weight"))


SOFT = "+soft AS (SELECT *, exp(0.5 * ref_logprob - max(0.5 * ref_logprob) OVER w) / sum(exp(0.5 * ref_logprob)) OVER w * exp(max(0.5 * ref_logprob) OVER w) AS p FROM good WINDOW w AS (PARTITION BY family_id))"


@query(SOFT + " SELECT trajectory_id, round(p, 9) AS state_prob FROM soft")
def state_softmax(spark, d):
    return targets.state_targets(_wins(spark, d), 0.5).select("trajectory_id", F.round("state_prob", 9).alias("state_prob"))


WW_ON = "JOIN soft r USING (family_id) WHERE (CASE WHEN c.trajectory_kind = 'base' THEN 0 ELSE 1 END, c.trajectory_id) < (CASE WHEN r.trajectory_kind = 'base' THEN 0 ELSE 1 END, r.trajectory_id)"


@query(SOFT + f" SELECT c.trajectory_id AS chosen_trajectory_id, r.trajectory_id AS rejected_trajectory_id, round(c.p / (c.p + r.p), 9) AS target FROM soft c {WW_ON}")
def pair_target_prob(spark, d):
    met = pairs.win_win(targets.state_targets(_wins(spark, d), 0.5))
    target = targets.pair_target(F.col("chosen.state_prob"), F.col("rejected.state_prob"))
    return met.select(F.col("chosen.trajectory_id").alias("chosen_trajectory_id"), F.col("rejected.trajectory_id").alias("rejected_trajectory_id"), F.round(target, 9).alias("target"))


@query(SOFT + f", rel AS (SELECT c.trajectory_id AS chosen_trajectory_id, r.trajectory_id AS rejected_trajectory_id, (ln(c.p) - ln(r.p)) - (c.ref_logprob - r.ref_logprob) AS m FROM soft c {WW_ON}) SELECT chosen_trajectory_id, rejected_trajectory_id, round(m, 7) AS margin, round(1 / (1 + exp(-0.1 * m)), 7) AS target FROM rel")
def ref_relative_target(spark, d):
    rows = pair_datasets.win_win_rows(_candidates(spark, d), PairConfig(most_repeats=MOST_REPEATS))
    return rows.select("chosen_trajectory_id", "rejected_trajectory_id", F.round("target_margin", 7).alias("margin"), F.round("chosen_target_prob", 7).alias("target"))


@query("SELECT task_slug, family_id, trajectory_id, action_text, count(*) OVER (PARTITION BY family_id) AS state_success_count FROM good")
def positive_rows(spark, d):
    return pairs.positives(_wins(spark, d)).select("task_slug", "family_id", "trajectory_id", "action_text", "state_success_count")


@query("SELECT task_slug, action_text, count(*) AS action_count FROM cand GROUP BY ALL")
def action_freq_task(spark, d):
    return divpo.action_counts(_candidates(spark, d), ["task_slug"])


@query("SELECT family_id, state_key, action_text, count(*) AS action_count FROM cand GROUP BY ALL")
def action_freq_state(spark, d):
    return divpo.action_counts(_candidates(spark, d), cand.STATE).drop("divergence_step")


@query("""+f AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY task_slug, action_text) AS s, CASE WHEN trajectory_kind = 'base' THEN 0 ELSE 1 END AS k FROM cand),
best AS (SELECT w.family_id, w.trajectory_id AS chosen_trajectory_id, l.trajectory_id AS rejected_trajectory_id, w.s AS chosen_score, l.s AS rejected_score,
  row_number() OVER (PARTITION BY w.family_id ORDER BY w.s DESC, l.s, w.k, w.trajectory_id, l.k, l.trajectory_id) AS rn FROM f w JOIN f l USING (family_id) WHERE w.is_win AND NOT l.is_win AND w.k + l.k > 0)
SELECT family_id, chosen_trajectory_id, rejected_trajectory_id, round(chosen_score, 9) AS chosen_score, round(rejected_score, 9) AS rejected_score FROM best WHERE rn = 1""")
def divpo_select(spark, d):
    rows = pair_datasets.divpo_rows(_candidates(spark, d), PairConfig())
    side = lambda s: [F.col(f"{s}.trajectory_id").alias(f"{s}_trajectory_id"), F.round(f"{s}.diversity_score", 9).alias(f"{s}_score")]
    return rows.select("family_id", *side("chosen"), *side("rejected"))


TURN = """+t0 AS (SELECT trajectory_id, step, turn_action AS a, turn_action IN ('turn left', 'turn right') AS t FROM step),
t1 AS (SELECT *, CASE WHEN lag(t) OVER w = t THEN 0 ELSE 1 END AS fresh, CASE WHEN lag(a) OVER w = a THEN 1 ELSE 0 END AS rep FROM t0 WINDOW w AS (PARTITION BY trajectory_id ORDER BY step)),
t2 AS (SELECT *, sum(fresh) OVER (PARTITION BY trajectory_id ORDER BY step) AS blk FROM t1),
t3 AS (SELECT *, count(*) OVER b AS n, row_number() OVER (PARTITION BY trajectory_id, blk ORDER BY step) AS rn, min(a) OVER b = max(a) OVER b AS same, sum(CASE WHEN fresh = 0 THEN rep ELSE 0 END) OVER b AS reps FROM t2 WINDOW b AS (PARTITION BY trajectory_id, blk)),
kept AS (SELECT *, NOT t OR CASE WHEN same THEN rn <= n % 4 WHEN reps = 0 AND n >= 4 THEN rn > n - n % 2 ELSE true END AS keep FROM t3),
key AS (SELECT trajectory_id, string_agg(a, '>' ORDER BY step) AS raw_key, coalesce(string_agg(a, '>' ORDER BY step) FILTER (keep), '') AS effective_key, count(*) FILTER (NOT keep) AS removed FROM kept GROUP BY trajectory_id)"""


def _keys(spark, d):
    kept = diversity.prune_turns(_steps(spark, d))
    rows = diversity.sequences(kept, "turn_action").withColumnRenamed("actions", "raw").join(diversity.sequences(kept, "turn_action", F.col("keep")).withColumnRenamed("actions", "effective"), "trajectory_id")
    pruned = F.filter("effective", lambda a: a.isNotNull())
    return rows.select("trajectory_id", F.array_join("raw", ">").alias("raw_key"), F.array_join(pruned, ">").alias("effective_key"), (F.size("raw") - F.size(pruned)).cast("long").alias("removed"))


@query(TURN + " SELECT trajectory_id, raw_key, effective_key, removed FROM key")
def turn_noise(spark, d):
    return _keys(spark, d)


LOOPS = """+ls AS (SELECT trajectory_id, row_number() OVER (PARTITION BY trajectory_id ORDER BY step) AS k, {'a': action, 'pre': CAST(obs_pre AS VARCHAR), 'post': CAST(obs_post AS VARCHAR), 'fixed': done} AS x FROM step WHERE trim(coalesce(action, '')) <> ''),
walk(trajectory_id, k, stack) AS (SELECT trajectory_id, CAST(0 AS BIGINT), list_filter([x], lambda y: false) FROM ls WHERE k = 1 UNION ALL
  SELECT w.trajectory_id, l.k, CASE WHEN x.pre = x.post AND NOT x.fixed THEN stack
    WHEN len(stack) > 0 AND CASE stack[-1].a WHEN 'up' THEN 'down' WHEN 'down' THEN 'up' WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' END = x.a AND stack[-1].pre <> '' AND stack[-1].pre = x.post AND NOT stack[-1].fixed AND NOT x.fixed THEN stack[1:-2]
    ELSE list_append(stack, x) END FROM walk w JOIN ls l ON l.trajectory_id = w.trajectory_id AND l.k = w.k + 1),
ended AS (SELECT trajectory_id, arg_max(stack, k) AS stack, max(k) AS n FROM walk GROUP BY trajectory_id)
SELECT trajectory_id, coalesce(array_to_string(list_transform(stack, lambda y: y.a), '>'), '') AS effective_key, CAST(n - len(stack) AS INTEGER) AS removed FROM ended"""


@query(LOOPS, recursive=True)
def noop_loop_prune(spark, d):
    rows = diversity.prune_loops(_steps(spark, d).withColumn("final", F.col("done")))
    return rows.select("trajectory_id", F.array_join("actions", ">").alias("effective_key"), "removed")


ENTROPY = "exp(-sum(c * 1.0 / n * ln(c * 1.0 / n)))"


@query(f"SELECT lang, count(*) AS unique_items, CAST(sum(c) AS BIGINT) AS total, round({ENTROPY}, 7) AS hill FROM (SELECT *, sum(c) OVER (PARTITION BY lang) AS n FROM (SELECT lang, source, count(*) AS c FROM documents GROUP BY lang, source)) GROUP BY lang", with_steps=False)
def hill_numbers(spark, d):
    found = diversity.hill(_table(spark, d, "documents"), ["lang"], "source")
    return found.withColumn("hill", F.round("hill", 7))


@query(TURN + f""", ep AS (SELECT task_slug, week <> 3 AS is_valid, terminal_progression >= 1 AS is_success, raw_key, effective_key, removed FROM traj JOIN key USING (trajectory_id)),
base AS (SELECT task_slug, count(*) AS episode_count, count(*) FILTER (is_valid) AS valid_episode_count, count(*) FILTER (is_success) AS success_count, count(*) FILTER (is_success AND removed > 0) AS changed_success_trajectories FROM ep GROUP BY ALL),
raw AS (SELECT task_slug, count(*) AS u, {ENTROPY} AS h FROM (SELECT *, sum(c) OVER (PARTITION BY task_slug) AS n FROM (SELECT task_slug, raw_key, count(*) AS c FROM ep WHERE is_success GROUP BY task_slug, raw_key)) GROUP BY task_slug),
eff AS (SELECT task_slug, count(*) AS u, {ENTROPY} AS h FROM (SELECT *, sum(c) OVER (PARTITION BY task_slug) AS n FROM (SELECT task_slug, effective_key, count(*) AS c FROM ep WHERE is_success GROUP BY task_slug, effective_key)) GROUP BY task_slug)
SELECT b.*, raw.u AS raw_unique, eff.u AS effective_unique, round(raw.h, 6) AS raw_hill, round(eff.h, 6) AS effective_hill, round(raw.u / valid_episode_count, 7) AS raw_esd, round(eff.h / success_count, 7) AS effective_h_wsd FROM base b JOIN raw USING (task_slug) JOIN eff USING (task_slug)""")
def effective_diversity(spark, d):
    rows = ev.trajectories(_steps(spark, d)).join(_keys(spark, d), "trajectory_id")
    rows = rows.withColumns({"is_valid": F.col("week") != 3, "is_success": outcomes.by_progression(F.col("terminal_progression"))})
    found = diversity.effective_diversity(rows, ["task_slug"])
    names = ["task_slug", "episode_count", "valid_episode_count", "success_count", "changed_success_trajectories", "raw_unique", "effective_unique"]
    return found.select(*names, *(F.round(c, n).alias(c) for c, n in (("raw_hill", 6), ("effective_hill", 6), ("raw_esd", 7), ("effective_h_wsd", 7))))


@query("+r AS (SELECT task_slug, week, avg(CASE WHEN terminal_progression >= 1 THEN 1.0 ELSE 0.0 END) AS v FROM traj GROUP BY ALL) SELECT task_slug, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, count(v) AS runs FROM r GROUP BY task_slug")
def metric_rollup(spark, d):
    runs = ev.trajectories(_steps(spark, d)).groupBy("task_slug", "week").agg(F.avg(F.when(F.col("terminal_progression") >= 1, 1.0).otherwise(0.0)).alias("v"))
    return diversity.metric_rollup(runs, ["task_slug"], "v").select("task_slug", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "runs")


SHOP = "CASE action WHEN 'idle' THEN 'search[shoes]' WHEN 'up' THEN 'click[buy now]' WHEN 'down' THEN 'click[b00abc1234]' WHEN 'right' THEN 'click[red]' ELSE 'wait' END"


@query("SELECT trajectory_id, string_agg(CASE action WHEN 'idle' THEN 'search' WHEN 'up' THEN 'click:buy now' WHEN 'down' THEN 'click:product' WHEN 'right' THEN 'click:option' ELSE 'other' END, ' > ' ORDER BY step) AS signature FROM step GROUP BY trajectory_id")
def type_signature(spark, d):
    a = F.col("action")
    shop = F.when(a == "idle", "search[shoes]").when(a == "up", "click[buy now]").when(a == "down", "click[b00abc1234]").when(a == "right", "click[red]").otherwise("wait")
    rows = diversity.sequences(_steps(spark, d).withColumn("shop", shop), "shop")
    return rows.select("trajectory_id", text.type_signature(F.col("actions")).alias("signature"))


@query("""+ep AS (SELECT week, week = 3 AND family_id % 3 = 0 AS aborted, terminal_progression >= 1 AS is_success, action_text FROM traj),
c AS (SELECT *, sum(c) OVER (PARTITION BY week) AS n FROM (SELECT week, action_text, count(*) AS c FROM ep WHERE is_success GROUP BY week, action_text)),
t AS (SELECT week, count(*) AS ways, max(c) AS top, exp(-sum(c * 1.0 / n * ln(c * 1.0 / n))) AS h FROM c GROUP BY week),
b AS (SELECT week, count(*) AS trajectory_count, count(*) FILTER (NOT aborted) AS non_aborted_count, count(*) FILTER (is_success) AS success_count FROM ep GROUP BY week)
SELECT week, trajectory_count, non_aborted_count, success_count, coalesce(ways, 0) AS unique_strategies, round(success_count / trajectory_count, 9) AS success_rate, round(success_count / non_aborted_count, 9) AS success_rate_non_aborted,
  round(coalesce(ways, 0) / trajectory_count, 9) AS esd, round(coalesce(h, 0) / trajectory_count, 7) AS h_esd, CASE WHEN success_count > 0 THEN round(ways / success_count, 9) ELSE 0 END AS wsd, CASE WHEN success_count > 0 THEN round(h / success_count, 7) ELSE 0 END AS h_wsd,
  CASE WHEN success_count > 0 THEN round(top / success_count, 9) ELSE 0 END AS top1_share FROM b LEFT JOIN t USING (week)""")
def strategy_summary(spark, d):
    rows = ev.trajectories(_steps(spark, d)).select("week", ((F.col("week") == 3) & (F.col("family_id") % 3 == 0)).alias("aborted"), outcomes.by_progression(F.col("terminal_progression")).alias("is_success"), F.col("action_text").alias("strategy"))
    found = diversity.strategy_summary(rows, ["week"])
    exact = ["week", "trajectory_count", "non_aborted_count", "success_count", "unique_strategies"]
    return found.select(*exact, *(F.round(c, 7 if c.startswith("h_") else 9).alias(c) for c in found.columns if c not in exact))


@query("""SELECT c.conv_id, c.turn, least((SELECT count(*) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND trim(coalesce(p.text, '')) <> ''), 16) AS prompt_messages, sha256(trim(c.text, chr(32) || chr(10) || chr(9))) AS completion_sha256
FROM conversations c WHERE c.role = 'assistant' AND trim(coalesce(c.text, '')) <> '' AND c.turn > (SELECT min(turn) FROM conversations p WHERE p.conv_id = c.conv_id AND trim(coalesce(p.text, '')) <> '')""", with_steps=False)
def sft_rows(spark, d):
    rows = sft.rows_from_turns(_table(spark, d, "conversations"))
    return rows.select("conv_id", "turn", F.size("prompt").cast("long").alias("prompt_messages"), F.sha2(F.col("completion")[0]["content"], 256).alias("completion_sha256"))


REBALANCE = """WITH base AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
cnt AS (SELECT conv_id, count(*) AS n, row_number() OVER (ORDER BY conv_id) AS rk FROM base GROUP BY conv_id),
tot AS (SELECT sum(n) AS rows_, count(*) AS groups_ FROM cnt),
plan AS (SELECT conv_id, n, CAST(rows_ // groups_ + CASE WHEN rk <= rows_ % groups_ THEN 1 ELSE 0 END AS BIGINT) AS t FROM cnt, tot),
place AS (SELECT conv_id, n, t, unnest(range(t)) AS place FROM plan),
pick AS (SELECT conv_id, place, CASE WHEN t >= n THEN place % n ELSE least(n - 1, (2 * place + 1) * n // (2 * t)) END AS i FROM place)"""


@query(REBALANCE + " SELECT conv_id, place, turn FROM pick JOIN base USING (conv_id, i)", with_steps=False)
def sft_rebalance(spark, d):
    rows = sft.rebalanced(_table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), "turn")


@query("SELECT count(*) AS plan_rows, count(DISTINCT k) AS distinct_rows, round(count(*) / count(DISTINCT k), 9) AS reuse_ratio FROM (SELECT o_orderkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey)", with_steps=False)
def sample_plan(spark, d):
    rows = _table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"))
    plan = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_idx"))
    return sft.plan_summary(sft.by_plan(rows, plan)).withColumn("reuse_ratio", F.round("reuse_ratio", 9))


@query("SELECT conv_id, turn, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS history_sha256 FROM conversations".replace("string_agg(coalesce(text, ''), chr(10) ORDER BY turn)", "string_agg(coalesce(text, ''), chr(10))"), with_steps=False)
def history_window(spark, d):
    rows = sft.history(_table(spark, d, "conversations"), most=4)
    return rows.select("conv_id", "turn", F.sha2("history", 256).alias("history_sha256"))


@query("SELECT conv_id, turn, sha256(string_agg(coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) AS history_sha256 FROM conversations", with_steps=False)
def history_window_default(spark, d):
    rows = sft.history(_table(spark, d, "conversations"))
    return rows.select("conv_id", "turn", F.sha2("history", 256).alias("history_sha256"))


@query("""SELECT trajectory_id, array_to_string(CASE WHEN n_steps < 2 THEN [] WHEN n_steps - 1 <= 5 THEN range(1, n_steps)
  ELSE list_sort(list_distinct([1, n_steps - 1, CAST(round_even((n_steps - 2) / 4.0, 0) AS BIGINT) + 1, CAST(round_even(2 * (n_steps - 2) / 4.0, 0) AS BIGINT) + 1, CAST(round_even(3 * (n_steps - 2) / 4.0, 0) AS BIGINT) + 1])) END, ',') AS steps FROM traj""")
def divergence_steps_uniform(spark, d):
    rows = ev.trajectories(_steps(spark, d))
    return rows.select("trajectory_id", F.array_join(branching.uniform_steps(F.col("n_steps"), 5).cast("array<string>"), ",").alias("steps"))


@query()
def alt_sample_random(spark, d):
    rows = ev.trajectories(_steps(spark, d))
    moves = F.array(*(F.lit(m) for m in ev.MOVES.values()))
    return rows.select("trajectory_id", F.array_join(pt.random_alternatives(moves, F.col("action_text"), F.lit(3), F.col("trajectory_id")), ",").alias("alternatives"))


@query("SELECT trajectory_id, CAST(CAST('0x' || substr(sha1('seed' || chr(10) || '<SEP>' || chr(10) || trajectory_id), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM traj")
def stable_seed(spark, d):
    rows = ev.trajectories(_steps(spark, d))
    return rows.select("trajectory_id", text.stable_int(F.lit("seed"), F.col("trajectory_id")).cast("string").alias("seed"))


STEPS_OF = """CASE WHEN n_steps < 2 THEN [] WHEN n_steps - 1 <= 5 THEN range(1, n_steps)
  ELSE list_sort(list_distinct([1, n_steps - 1, CAST(round_even((n_steps - 2) / 4.0, 0) AS BIGINT) + 1, CAST(round_even(2 * (n_steps - 2) / 4.0, 0) AS BIGINT) + 1, CAST(round_even(3 * (n_steps - 2) / 4.0, 0) AS BIGINT) + 1])) END"""


@query(f"""+ds AS (SELECT trajectory_id, task_slug, week, unnest({STEPS_OF}) AS divergence_step FROM traj)
SELECT trajectory_id, divergence_step, sha1(any_value(ds.task_slug) || chr(10) || '<SEP>' || chr(10) || any_value(ds.week) || chr(10) || '<SEP>' || chr(10) || '[' || string_agg('"' || action || '"', ', ' ORDER BY step) || ']') AS state_key
  FROM ds JOIN step USING (trajectory_id) WHERE step < divergence_step GROUP BY trajectory_id, divergence_step""")
def state_key(spark, d):
    """Each trajectory at each of its divergence steps: all actions before the step, its task and, as its seed, its week."""
    steps = _steps(spark, d)
    rows = ev.trajectories(steps).join(diversity.sequences(steps), "trajectory_id")
    rows = rows.select("trajectory_id", "task_slug", "week", "actions", F.explode(branching.uniform_steps(F.col("n_steps"), 5)).alias("divergence_step"))
    return rows.select("trajectory_id", "divergence_step", pt.state_key("task_slug", "week", branching.prefix(F.col("actions"), F.col("divergence_step"))).alias("state_key"))


@query("SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'search' WHEN url LIKE '%/fr/%' THEN 'product_click' WHEN url LIKE '%/de/%' THEN 'buy_now' WHEN url LIKE '%/es/%' THEN 'navigation' ELSE 'other' END AS kind FROM pages", with_steps=False)
def action_types(spark, d):
    u = F.col("url")
    action = F.when(u.contains("/en/"), "  Search[ A  b ] ").when(u.contains("/fr/"), "'CLICK[B00ABC1234]'").when(u.contains("/de/"), "click[ Buy  Now ]").when(u.contains("/es/"), "click[Next >]").otherwise("wait")
    return _table(spark, d, "pages").select("page_id", text.shop_action_type(action).alias("kind"))


@query(f"+{BRANCH} SELECT task_slug, coalesce(base_traj_id, '') AS base_traj_id, coalesce(divergence_step, -1) AS divergence_step, count(*) FILTER (status = 'generated') AS generated, count(*) FILTER (status <> 'generated') AS failed FROM br WHERE status IS NOT NULL GROUP BY GROUPING SETS ((task_slug), (task_slug, base_traj_id, divergence_step))")
def branch_summary(spark, d):
    found = branching.summary(_branches(spark, d).where("status is not null"))
    return found.withColumns({"base_traj_id": F.coalesce("base_traj_id", F.lit("")), "divergence_step": F.coalesce("divergence_step", F.lit(-1))})


@query(f"+{BRANCH} SELECT trajectory_id FROM traj t WHERE trajectory_kind = 'alt' AND NOT EXISTS (SELECT 1 FROM br WHERE br.alt_traj_id = t.trajectory_id AND status IS NOT NULL AND status <> 'retry_exhausted' AND (status <> 'generated' OR files_exist))")
def resume_antijoin(spark, d):
    jobs = ev.trajectories(_steps(spark, d)).where("trajectory_kind = 'alt'").select("trajectory_id")
    return resume.remaining(jobs, _branches(spark, d).withColumnRenamed("alt_traj_id", "trajectory_id"), ["trajectory_id"])


@query(f"+{BRANCH}, u AS (SELECT family_id, alt_traj_id, ord, 0 AS p FROM br UNION ALL SELECT family_id, alt_traj_id, ord, 1 FROM br WHERE alt_index = 2) SELECT family_id, alt_traj_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY p DESC, ord DESC, alt_traj_id DESC) AS rn FROM u) WHERE rn = 1")
def resume_merge(spark, d):
    rows = _branches(spark, d).select("family_id", "alt_traj_id", "ord", "alt_index", F.struct("ord", "alt_traj_id").alias("o"))
    return resume.merged(rows, rows.where("alt_index = 2"), ["family_id"], "o").select("family_id", "alt_traj_id", "ord")


@query("SELECT c_custkey, ntile(7) OVER (ORDER BY c_custkey) - 1 AS worker FROM customer", with_steps=False)
def shards(spark, d):
    return branching.shards(_table(spark, d, "customer").select("c_custkey"), "c_custkey", 7)


@query("SELECT family_id, count(*) AS branch_count, string_agg(trajectory_id, ',' ORDER BY week) AS branches FROM traj WHERE trajectory_kind = 'alt' GROUP BY family_id")
def branch_sets(spark, d):
    rows = artifacts.branch_sets(ev.trajectories(_steps(spark, d)).where("trajectory_kind = 'alt'"), ["family_id"], ["trajectory_id"], "week")
    return rows.select("family_id", "branch_count", F.array_join(F.transform("branches", lambda b: b["trajectory_id"]), ",").alias("branches"))


@query("SELECT c.task_slug, 'win_lose' AS pair_type, c.action_text AS chosen, r.action_text AS rejected, CASE WHEN c.family_id % 2 = 0 THEN 1.0 ELSE 0.25 END AS target_prob, CASE WHEN c.family_id % 3 = 0 THEN 1.0 ELSE CAST(c.family_id % 3 AS DOUBLE) END AS weight FROM good c JOIN cand r ON c.family_id = r.family_id WHERE NOT r.is_win AND NOT (c.trajectory_kind = 'base' AND r.trajectory_kind = 'base')")
def pair_records(spark, d):
    rows = _candidates(spark, d)
    flat = pairs.pair_rows(pairs.win_lose(pairs.good_wins(rows, MOST_REPEATS), rows.where("not is_win")), "win_lose")
    explicit = F.when(F.col("family_id") % 2 == 0, 0.0).otherwise(0.25)
    return artifacts.pair_records(flat, (F.col("family_id") % 3).cast("double"), explicit).drop("metadata")


@query("WITH n AS (SELECT (SELECT count(*) FROM supplier) AS a, (SELECT count(*) FROM nation) AS b) SELECT i AS place, s_suppkey, n_nationkey FROM (SELECT unnest(range(greatest(a, b))) AS i, a, b FROM n) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS si FROM supplier) ON si = i % a JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS ni FROM nation) ON ni = i % b", with_steps=False)
def balanced_zip(spark, d):
    def indexed(name, key):
        return branching.ranked(_table(spark, d, name).select(key), key, name="i")[0]

    met = zip_rows(indexed("supplier", "s_suppkey"), indexed("nation", "n_nationkey"))
    return met.select("place", F.col("a_s_suppkey").alias("s_suppkey"), F.col("b_n_nationkey").alias("n_nationkey"))


@query("""+x AS (SELECT event_id, 0.1 * (value - 25) AS dd, event_id % 2 = 0 AS tie, (event_id % 10) / 10.0 AS t FROM events)
SELECT event_id, round(ln(1 + exp(-dd)), 7) AS dpo,
  round(CASE WHEN tie THEN -ln(exp(2 * ln(3)) - 1) + ln(1 + exp(dd + ln(3))) + ln(1 + exp(-dd + ln(3))) ELSE ln(1 + exp(-dd + ln(3))) END, 7) AS rao_kupper,
  round(ln(1 + exp(-dd) + exp(ln(2) - dd / 2)) - CASE WHEN tie THEN ln(2) - dd / 2 ELSE 0 END, 7) AS davidson,
  round(t * ln(1 + exp(-dd)) + (1 - t) * ln(1 + exp(dd)), 7) AS soft_target FROM x""")
def loss_terms(spark, d):
    rows = _table(spark, d, "events").select("event_id", (F.col("value") - 25).alias("gap"), (F.col("event_id") % 2 == 0).alias("is_tie"), ((F.col("event_id") % 10) / 10.0).alias("target"))
    return rows.select("event_id", *(F.round(c, 7).alias(k) for k, c in targets.loss_terms().items()))


@query("SELECT trajectory_id, string_agg(action || '=' || n, ',' ORDER BY action) AS frequency FROM (SELECT trajectory_id, action, count(*) AS n FROM step GROUP BY ALL) GROUP BY trajectory_id")
def action_histogram(spark, d):
    found = episodes.action_histogram(_steps(spark, d))
    items = F.transform(F.map_entries("action_frequency"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("trajectory_id", F.array_join(F.array_sort(items), ",").alias("frequency"))


@query("SELECT trajectory_id, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 10) AS BIGINT) AS output_tokens, count(*) AS request_count, round(count(*) * 60 / sum(1 + step), 9) AS rpm, round((sum(event_id % 100) + sum(event_id % 10)) * 60 / sum(1 + step), 7) AS tpm FROM step GROUP BY trajectory_id")
def episode_rates(spark, d):
    found = episodes.rates(_steps(spark, d), "trajectory_id", F.col("event_id") % 100, F.col("event_id") % 10, (F.col("step") + 1).cast("double"), F.lit(1))
    return found.select("trajectory_id", "input_tokens", "output_tokens", "request_count", F.round("rpm", 9).alias("rpm"), F.round("tpm", 7).alias("tpm"))


@query("SELECT action AS reason, count(*) AS occurrences FROM step WHERE done GROUP BY action")
def abort_reasons(spark, d):
    return episodes.abort_reasons(_steps(spark, d).where("done"), "action")


@query("""+x AS (SELECT 0.1 * (value - 25) AS dd, event_id % 2 = 0 AS tie, (event_id % 10) / 10.0 AS t, (1 + event_id % 3) * 1.0 AS w FROM events),
y AS (SELECT avg(w * ln(1 + exp(-dd))) FILTER (NOT tie) AS p, avg(w * (t * ln(1 + exp(-dd)) + (1 - t) * ln(1 + exp(dd)))) FILTER (tie) AS v FROM x) SELECT round(p, 9) AS pref_loss, round(v, 9) AS div_loss, round(p + v, 9) AS loss FROM y""")
def balanced_loss(spark, d):
    n = F.col("event_id")
    rows = _table(spark, d, "events").select((F.col("value") - 25).alias("gap"), (n % 2 == 0).alias("is_tie"), ((n % 10) / 10.0).alias("target"), (1.0 + n % 3).alias("weight"))
    return targets.balanced_loss(rows).select(*(F.round(c, 9).alias(c) for c in ("pref_loss", "div_loss", "loss")))


@query("""+x AS (SELECT value AS c, 25.0 AS r, value - 25 AS g, event_id % 2 = 0 AS tie FROM events), aim AS (SELECT avg(c) FILTER (NOT tie) AS a FROM x),
y AS (SELECT avg(ln(1 + exp(-0.1 * g))) FILTER (NOT tie) AS p, avg(g * g) FILTER (tie) AS m, 0.5 * avg(greatest(a - c, 0) ** 2 + greatest(a - r, 0) ** 2) FILTER (tie) AS f FROM x, aim) SELECT round(p, 8) AS pref_loss, round(m + f, 6) AS div_loss, round(p + m + f, 6) AS loss FROM y""")
def floor_loss(spark, d):
    n = F.col("event_id")
    rows = _table(spark, d, "events").select(F.col("value").alias("chosen_reward"), F.lit(25.0).alias("rejected_reward"), (F.col("value") - 25).alias("gap"), (n % 2 == 0).alias("is_tie"))
    found = targets.gap_loss(rows, floor=True)
    return found.select(F.round("pref_loss", 8).alias("pref_loss"), F.round("div_loss", 6).alias("div_loss"), F.round("loss", 6).alias("loss"))


@query("SELECT l_orderkey, count(*) AS occurrences FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1", with_steps=False)
def duplicates(spark, d):
    return checks.duplicates(_table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", with_steps=False)
def missing_tasks(spark, d):
    return checks.missing(_table(spark, d, "customer"), _table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT conv_id, turn, 'short' AS rule FROM conversations WHERE length(coalesce(text, '')) < 40 UNION ALL SELECT conv_id, turn, 'role' FROM conversations WHERE role NOT IN ('user', 'assistant')", with_steps=False)
def row_violations(spark, d):
    rows = _table(spark, d, "conversations")
    rules = {"short": F.length(F.coalesce("text", F.lit(""))) >= 40, "role": F.col("role").isin("user", "assistant")}
    return checks.violations(rows.select("conv_id", "turn", "role", "text"), rules).select("conv_id", "turn", "rule")


@query("SELECT doc_id, lower(regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, array_to_string(list_slice(string_split(lang || '/x/' || source, '/'), -1, -1), '') AS task FROM documents", with_steps=False)
def slugs(spark, d):
    return _table(spark, d, "documents").select("doc_id", text.safe_slug(F.col("source")).alias("slug"), text.task_slug(F.concat_ws("/x/", "lang", "source")).alias("task"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_int, coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE), -1.0) AS missing_float, coalesce(CASE json_extract_string(props, '$.k') WHEN '1' THEN true WHEN '0' THEN false END, false) AS k_bool FROM events", with_steps=False)
def loose_casts(spark, d):
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return _table(spark, d, "events").select("event_id", casts.int_or(get("k"), None).alias("k_int"), casts.float_or(get("missing"), -1.0).alias("missing_float"), F.coalesce(casts.bool_or_null(get("k")), F.lit(False)).alias("k_bool"))


@query()
def action_extraction(spark, d):
    rows = _table(spark, d, "conversations").where("role = 'assistant'")
    both = pt.extract_thought_action(F.concat(F.lit("Thought: "), F.coalesce("text", F.lit("")), F.lit("\nAction: - go "), F.col("turn").cast("string"), F.lit(" (now)")))
    return rows.select("conv_id", "turn", both.alias("b")).select("conv_id", "turn", "b.thought", "b.action")


@query()
def instruction_queries(spark, d):
    return _table(spark, d, "benchmark").select("item_id", F.array_join(text.search_queries(F.col("text")), "|").alias("queries"))


SHOWN = "'go on' || chr(10) || chr(10) || 'Current Observation:' || chr(10) || s.obs_pre || chr(10) || chr(10) || 'Your response should use the following format:' || chr(10) || chr(10) || 'Thought: <your thoughts>' || chr(10) || 'Action: <your next action>'"


@query(f"""+{STATES} SELECT family_id, divergence_step, state_key, c.trajectory_id AS chosen_trajectory_id, r.trajectory_id AS rejected_trajectory_id, c.trajectory_kind AS chosen_trajectory_kind, r.trajectory_kind AS rejected_trajectory_kind,
  'win_lose' AS pair_type, 'observed_win_lose' AS pair_semantics, c.task_slug AS task_id, CASE WHEN 'base' IN (c.trajectory_kind, r.trajectory_kind) THEN 'base-alt' ELSE 'alt-alt' END AS pair_origin,
  c.trajectory_id AS chosen_source_trace, r.quality_score AS rejected_quality_score, sha256({SHOWN}) AS prompt_sha256, 'Action: ' || c.action_text AS chosen_text, 'Action: ' || r.action_text AS rejected_text, c.is_win AS chosen_success, r.is_win AS rejected_success
  FROM sg c JOIN sc r USING (family_id, divergence_step, state_key) JOIN step s ON s.trajectory_id = family_id AND s.step = divergence_step WHERE NOT r.is_win AND NOT (c.trajectory_kind = 'base' AND r.trajectory_kind = 'base')""")
def branch_pair_rows(spark, d):
    rows = _at_states(spark, d)
    flat = pairs.whole_rows(pairs.win_lose(pairs.good_wins(rows, MOST_REPEATS), rows.where("not is_win")), "win_lose")
    return flat.select(
        *cand.STATE, "chosen_trajectory_id", "rejected_trajectory_id", "chosen_trajectory_kind", "rejected_trajectory_kind", "pair_type", "pair_semantics", "task_id", "pair_origin", "chosen_source_trace", "rejected_quality_score",
        F.sha2("prompt", 256).alias("prompt_sha256"), F.col("chosen.action_text").alias("chosen_text"), F.col("rejected.action_text").alias("rejected_text"), F.col("chosen.success").alias("chosen_success"), F.col("rejected.success").alias("rejected_success"),
    )


def _trace_rows(spark, d):
    traces = ev.traces(_steps(spark, d)).where("trajectory_kind = 'base'")
    return trace_rows.rows_from_calls(traces, outcomes.by_progression(F.col("last.progression")), success_only=True), traces


WON = "won AS (SELECT t.trajectory_id, t.task_slug, t.n_steps, t.terminal_reward FROM traj t WHERE trajectory_kind = 'base' AND terminal_progression >= 1)"


@query(f"+{WON} SELECT trajectory_id, w.task_slug AS task_id, s.step AS episode_step, s.action AS action_text, 'Action: ' || s.action AS completion, sha256({SHOWN}) AS prompt_sha256, w.n_steps AS trajectory_total_steps, w.terminal_reward AS trajectory_total_reward FROM won w JOIN step s USING (trajectory_id)")
def sft_trace_rows(spark, d):
    rows, _ = _trace_rows(spark, d)
    return rows.select("trajectory_id", "task_id", "episode_step", "action_text", F.col("completion")[0]["content"].alias("completion"), F.sha2(text.flatten(F.col("prompt")), 256).alias("prompt_sha256"), "trajectory_total_steps", "trajectory_total_reward")


@query(f"+{WON}, b AS (SELECT t.task_slug AS task, w.n_steps AS n FROM traj t LEFT JOIN won w USING (trajectory_id) WHERE t.trajectory_kind = 'base') SELECT coalesce(task, 'all') AS task, count(n) AS trajectory_count, count(*) FILTER (n IS NULL) AS skipped, CAST(coalesce(sum(n), 0) AS BIGINT) AS output_rows FROM b GROUP BY ROLLUP (task)")
def sft_trace_stats(spark, d):
    rows, traces = _trace_rows(spark, d)
    return trace_rows.task_counts(rows, traces).withColumn("task", F.coalesce("task", F.lit("all")))


@query(f"+{WON} SELECT CAST(sum(n_steps) AS BIGINT) AS row_count, count(*) AS family_count, count(*) AS trajectory_count, 2 AS max_prompt_messages, 1 AS max_completion_messages FROM won")
def sft_trace_summary(spark, d):
    return trace_rows.summary(_trace_rows(spark, d)[0])


MOVE = "['idle', 'up', 'down', 'right', 'left']"


def _jobs(spark, d):
    steps = _steps(spark, d)
    bases = ev.trajectories(steps).where("trajectory_kind = 'base'").withColumn("is_success", outcomes.by_progression(F.col("terminal_progression")))
    bases = planning.bases_to_branch(bases, success_only=True).join(diversity.sequences(steps), "trajectory_id")
    moves = F.array(*(F.lit(m) for m in ("idle", "up", "down", "right", "left")))
    return planning.jobs(bases, branching.uniform_steps(F.col("n_steps"), 5), planning.other_actions(moves, F.col("base_action"), 3))


PLAN = f"""ds AS (SELECT trajectory_id, task_slug, unnest({STEPS_OF}) AS divergence_step FROM traj WHERE trajectory_kind = 'base' AND terminal_progression >= 1),
js AS (SELECT ds.*, s.action AS base_action, list_filter({MOVE}, lambda a: a <> s.action)[1:3] AS others FROM ds JOIN step s ON s.trajectory_id = ds.trajectory_id AND s.step = divergence_step),
job AS (SELECT task_slug, trajectory_id AS base_traj_id, divergence_step, unnest(range(len(others))) AS alt_index, base_action, unnest(others) AS alt_action FROM js)"""


@query(f"""+{PLAN} SELECT j.task_slug, base_traj_id, divergence_step, alt_index, base_action, alt_action, format('{{}}__dtc_d{{:02d}}_a{{:02d}}', base_traj_id, divergence_step, alt_index) AS alt_traj_id, string_agg(s.action, '>' ORDER BY s.step) AS prefix
  FROM job j JOIN step s ON s.trajectory_id = base_traj_id AND s.step < divergence_step GROUP BY ALL""")
def branch_plan(spark, d):
    return planning.in_order(_jobs(spark, d), planning.JOB_ORDER).withColumn("prefix", F.array_join("prefix_actions", ">")).drop("prefix_actions")


ROUND = "rec AS (SELECT *, CASE (divergence_step + alt_index) % 4 WHEN 0 THEN 'generated' WHEN 1 THEN 'retry_exhausted' WHEN 2 THEN 'worker_exception' END AS status FROM job)"


@query(f"+{PLAN}, {ROUND} SELECT task_slug, base_traj_id, divergence_step, alt_index, CASE WHEN status IS NULL THEN 1 ELSE 2 END AS job_attempt FROM rec WHERE status IS NULL OR status <> 'generated'")
def retry_round(spark, d):
    plan = _jobs(spark, d)
    k = (F.col("divergence_step") + F.col("alt_index")) % 4
    tried = plan.select(*resume.KEY, F.when(k == 0, "generated").when(k == 1, "retry_exhausted").when(k == 2, "worker_exception").alias("status"), F.lit(True).alias("files_exist"), F.lit(1).alias("ord"))
    return planning.next_round(plan.select(resume.KEY), tried, 2)


@query(f"+{BRANCH} SELECT task_slug, count(*) AS records, count(*) FILTER (status = 'generated') AS generated, count(*) FILTER (status = 'replay_mismatch') AS replay_mismatch, count(*) FILTER (status = 'retry_exhausted') AS retryable, count(*) FILTER (status IS NULL) AS unknown FROM br GROUP BY task_slug")
def branch_status(spark, d):
    return planning.by_status(_branches(spark, d), ["task_slug"])


@query("SELECT t.trajectory_id, string_agg(action, '>' ORDER BY step) FILTER (NOT done) AS history, (SELECT count(DISTINCT action) FROM step x WHERE x.trajectory_id = t.trajectory_id AND NOT x.done) AS reasons, arg_max(action, step) FILTER (NOT done) AS last_failure FROM step t WHERE NOT done GROUP BY t.trajectory_id")
def failure_history(spark, d):
    found = planning.failure_fields(_steps(spark, d).where("not done"), ["trajectory_id"], "step", "action")
    return found.select("trajectory_id", F.array_join("failure_history", ">").alias("history"), F.size("failure_counts").cast("long").alias("reasons"), "last_failure")


@query("SELECT week, count(*) AS episodes, count(*) FILTER (terminal_progression >= 1) AS successes, round(count(*) FILTER (terminal_progression >= 1) / count(*), 9) AS success_rate FROM traj GROUP BY week")
def success_rates(spark, d):
    rows = ev.trajectories(_steps(spark, d)).withColumn("is_success", outcomes.by_progression(F.col("terminal_progression")))
    return records.successes(rows, ["week"]).withColumn("success_rate", F.round("success_rate", 9))


@query(f"+{BRANCH} SELECT alt_traj_id, CASE WHEN status IS NULL OR s.step IS NULL THEN state_key ELSE 'go on' || chr(10) || chr(10) || coalesce(s.obs_pre, 0) END AS prompt FROM br LEFT JOIN step s ON s.trajectory_id = base_traj_id AND s.step = divergence_step")
def branch_prompts(spark, d):
    steps = _steps(spark, d)
    known = _branches(spark, d).withColumn("base_traj_id", F.when(F.col("status").isNull(), F.lit("none")).otherwise(F.col("base_traj_id")))
    return records.with_prompts(known, ev.traces(steps).where("trajectory_kind = 'base'")).select("alt_traj_id", "prompt")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE event_id // 100 END AS session, value > 40 OR event_type = 'purchase' AS paid FROM events", with_steps=False)
def shop_sessions(spark, d):
    n = F.col("event_id")
    return _table(spark, d, "events").select("event_id", shopping.session_id(F.when(n % 3 == 0, n % 7), n).alias("session"), shopping.is_terminal_or_paid(F.col("value") - 40, F.col("event_type") == "purchase").alias("paid"))


@query("SELECT conv_id, turn, CASE WHEN text IS NULL THEN 0 ELSE strpos(reverse('Action: ' || text), ':noitcA') - 1 END AS behind FROM conversations", with_steps=False)
def loss_spans(spark, d):
    said = F.concat(F.lit("Action: "), "text")
    start = trace_rows.loss_start(F.concat(F.lit("prompt "), said), F.lit("prompt "), action_only=True)
    rows = _table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.when(F.col("text").isNull(), 0).otherwise(F.length(said) + 7 - start - 7).cast("long").alias("behind"))


@query("SELECT trajectory_id, string_agg(action, '>' ORDER BY step) AS way FROM step GROUP BY trajectory_id")
def raw_ways(spark, d):
    return diversity.ways(_steps(spark, d), "none").select("trajectory_id", F.array_join("actions", ">").alias("way"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE 'Thought: ' || role || chr(10) || chr(10) || 'Action: ' END || 'go ' || CAST(turn AS VARCHAR) AS said, CASE WHEN turn % 3 = 0 THEN 'go ' || CAST(turn AS VARCHAR) ELSE role END AS thought FROM conversations", with_steps=False)
def completions(spark, d):
    said = text.completion(F.when(F.col("turn") % 3 != 0, F.col("role")), F.concat(F.lit("go "), F.col("turn").cast("string")))
    return _table(spark, d, "conversations").select("conv_id", "turn", said.alias("said")).withColumn("thought", pt.extract_thought("said"))


NOTICE = "'Your previous output did not contain a valid action. Defaulted to action: go' || chr(10) || chr(10) || 'Observation:'"


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE '' END AS clean, CASE WHEN turn % 2 = 0 THEN {NOTICE} ELSE '' END AS notice, false AS changed FROM conversations""", with_steps=False)
def notices(spark, d):
    rows = _table(spark, d, "conversations")
    seen = F.when(F.col("turn") % 2 == 0, calls.with_notice(F.col("text"), F.lit("go"))).otherwise(F.coalesce("text", F.lit("")))
    parts = calls.split_notice(seen)
    return rows.select("conv_id", "turn", parts["clean"].alias("clean"), parts["notice"].alias("notice"), calls.is_changed(seen, F.col("text")).alias("changed"))


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN 'retry_exhausted' WHEN event_type = 'click' THEN 'cap_hit' WHEN event_type = 'purchase' OR event_id % 2 = 1 THEN 'invalid_action' END AS reason,
  CASE WHEN event_type = 'view' THEN 'timeout' WHEN event_id % 3 = 0 THEN 'connection' END AS failure FROM events""", with_steps=False)
def response_failures(spark, d):
    kind, n = F.col("event_type"), F.col("event_id")
    stop = F.when(kind == "signup", "Error-Max Retries").when(kind == "click", " finish: max tokens").when(kind == "purchase", "empty-response").when(kind == "view", "stop")
    failed = calls.retryable_failure(F.lit("net.Reset"), F.when(n % 3 == 0, 503).otherwise(400), F.when(kind == "view", "Read timed out"), ["net.Lost"], [502, 503])
    return _table(spark, d, "events").select("event_id", calls.abort_reason(stop, F.when(n % 2 == 0, "x").otherwise(" ")).alias("reason"), failed.alias("failure"))


@query("""SELECT trajectory_id, step, CASE WHEN turn_action IN ('turn left', 'turn right') THEN turn_action ELSE 'go forward' END AS action, turn_action NOT IN ('turn left', 'turn right') AS missed,
  CASE WHEN turn_action IN ('turn left', 'turn right') THEN 5 ELSE 6 END AS others FROM step""")
def valid_actions(spark, d):
    space = calls.action_space(F.lit("BabyAI"), F.lit(None).cast("string"))
    found = calls.taken(F.col("turn_action"), space, F.lit("go forward"))
    return _steps(spark, d).select("trajectory_id", "step", found["action"].alias("action"), found["missed"].alias("missed"), F.size(calls.without(space, F.array("turn_action"))).alias("others"))


@query("SELECT conv_id, turn, 'Action: ' || rtrim(turn || ' ' || substr(coalesce(text, ''), 1, 40), ' ' || chr(9) || chr(10) || chr(13)) AS scored FROM conversations", with_steps=False)
def scored_texts(spark, d):
    rows = _table(spark, d, "conversations")
    said = F.coalesce("text", F.lit(""))
    return rows.select("conv_id", "turn", calls.scored_text(F.concat(said, F.lit("\nAction: no\nAction: "), "turn", F.lit(" "), F.substring(said, 1, 40)), action_only=True).alias("scored"))


@query("SELECT trajectory_id AS episode_id, CAST(step AS INT) AS step, 'go on' AS instruction, CAST(obs_pre AS VARCHAR) AS observation_pre, action AS action_model, action AS action_executed, reward, progression, done AS terminated, done, false AS won, 0 AS input_tokens FROM step")
def trace_step_rows(spark, d):
    found = calls.step_rows(ev.traces(_steps(spark, d)))
    return found.select("episode_id", "step", "instruction", "observation_pre", "action_model", "action_executed", "reward", "progression", "terminated", "done", "won", "input_tokens")


@query("SELECT trajectory_kind AS source, task_slug, count(*) AS trajectories, count(*) FILTER (terminal_progression >= 1) AS wins, CAST(sum(n_steps) AS BIGINT) AS actions FROM traj GROUP BY ALL")
def pooled_bases(spark, d):
    steps = _steps(spark, d)
    rows = ev.trajectories(steps).withColumn("is_success", outcomes.by_progression(F.col("terminal_progression"))).join(diversity.sequences(steps), "trajectory_id")
    both = bases.pooled({k: rows.where(F.col("trajectory_kind") == k) for k in ("base", "alt")})
    return bases.counts(both, ["source", "task_slug"])


@query(f"""+{BRANCH} SELECT task_slug, base_traj_id, divergence_step, alt_index, arg_max(coalesce(status, ''), ord) AS status, max(ord) AS ord FROM br GROUP BY ALL""")
def stream_resume(spark, d):
    """The branch ledger fed as a stream of files; the same rows as one merge of all records."""
    from .streaming.ledger import holding, keep_ledger, records

    root = new_folder(spark, "ledger")
    rows = _branches(spark, d).select("task_slug", "base_traj_id", "divergence_step", F.col("alt_index"), F.coalesce("status", F.lit("")).alias("status"), "ord")
    rows.write.json(f"{root}/in")
    query_ = keep_ledger(records(spark, f"{root}/in", rows.schema), f"{root}/ledger", f"{root}/checkpoint")
    query_.awaitTermination()
    return holding(spark, f"{root}/ledger")
