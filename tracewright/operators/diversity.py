"""How many different ways lead to success: pruned action sequences, Hill numbers and their ratios."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = ("turn left", "turn right")
#: Moves that undo each other.
INVERSE = {"up": "down", "down": "up", "left": "right", "right": "left"}


def prune_turns(steps: DataFrame, action: str = "turn_action", trajectory: str = "trajectory_id", order: str = "step") -> DataFrame:
    """steps with keep: in each block of turns, equal ones count modulo 4 and strictly alternating ones modulo 2."""
    w = Window.partitionBy(trajectory).orderBy(order)
    block = Window.partitionBy(trajectory, "_block")
    turn = F.col(action).isin(*TURNS)
    marked = steps.withColumn("_turn", turn).withColumn("_new", F.coalesce((F.lag("_turn").over(w) != F.col("_turn")).cast("int"), F.lit(1)))
    marked = marked.withColumn("_block", F.sum("_new").over(w)).withColumn("_same", F.coalesce((F.lag(action).over(w) == F.col(action)) & (F.col("_new") == 0), F.lit(False)).cast("int"))
    counted = marked.withColumns({"_n": F.count(F.lit(1)).over(block), "_rn": F.row_number().over(block.orderBy(order)), "_low": F.min(action).over(block), "_high": F.max(action).over(block), "_reps": F.sum("_same").over(block)})
    n, rn = F.col("_n"), F.col("_rn")
    keep = F.when(~F.col("_turn"), True).when(F.col("_low") == F.col("_high"), rn <= n % 4).when((F.col("_reps") == 0) & (n >= 4), rn > n - n % 2).otherwise(True)
    return counted.withColumn("keep", keep).drop("_turn", "_new", "_block", "_same", "_n", "_rn", "_low", "_high", "_reps")


def sequences(steps: DataFrame, action: str = "action", keep: Column | None = None, trajectory: str = "trajectory_id", order: str = "step") -> DataFrame:
    """trajectory and actions, in order; a trajectory that loses all its steps has the empty sequence."""
    item = F.struct(F.col(order), F.col(action))
    rows = steps.groupBy(trajectory).agg(F.array_sort(F.collect_list(F.when(keep, item) if keep is not None else item)).alias("s"))
    return rows.select(trajectory, F.transform("s", lambda x: x[action]).alias("actions"))


def ways(steps: DataFrame, rule: str = "babyai_turn_noise") -> DataFrame:
    """trajectory_id and actions, its way by a rule: all actions, those that turns leave, or those that loops leave."""
    if rule in ("none", "babaisai_raw"):
        return sequences(steps)
    if rule == "babyai_turn_noise":
        return sequences(prune_turns(steps), "turn_action", F.col("keep"))
    if rule != "babaisai_noop_loop_prune":
        raise ValueError(f"no rule {rule}")
    if lacking := [c for c in ("obs_pre", "obs_post", "final") if c not in steps.columns]:
        raise ValueError(f"{rule} needs rows of step files with {', '.join(lacking)}")
    return prune_loops(steps).select("trajectory_id", "actions")


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (trajectory, order, a, pre, post, fixed), sorted by the first two: each trajectory's moves and how many went."""
    now, some, stack, removed, out = None, False, [], 0, []
    names = ["trajectory", "actions", "removed"]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.int32()))], names=names)
    for batch in batches:
        for key, _, action, pre, post, fixed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not some or key != now:
                if some:
                    out.append((now, [x[0] for x in stack], removed))
                now, some, stack, removed = key, True, [], 0
            if pre is not None and pre == post and not fixed:
                removed += 1
            elif stack and INVERSE.get(stack[-1][0]) == action and stack[-1][1] and stack[-1][1] == post and not stack[-1][2] and not fixed:
                stack.pop()
                removed += 2
            else:
                stack.append((action, pre, fixed))
        if out:
            yield made(out)
            out = []
    if some:
        yield made([(now, [x[0] for x in stack], removed)])


def prune_loops(steps: DataFrame, trajectory: str = "trajectory_id", order: str = "step", action: str = "action") -> DataFrame:
    """trajectory, actions and removed: steps without effect go, and so do two moves that undo each other.

    The rule is a stack over the steps in order, so one task walks a trajectory; it streams them, and holds the moves that are
    left, in time linear in the steps. A step that ends or pays is never taken away; one without an action doesn't count.
    """
    name = F.col(trajectory).cast("string").alias("trajectory")
    rows = steps.where(F.trim(F.coalesce(action, F.lit(""))) != "").select(
        name, F.col(order).cast("bigint").alias("at"), F.col(action).alias("a"), F.col("obs_pre").cast("string").alias("pre"), F.col("obs_post").cast("string").alias("post"), F.coalesce("final", F.lit(False)).alias("fixed")
    )
    dealt = rows.repartition("trajectory").sortWithinPartitions("trajectory", "at")
    found = dealt.mapInArrow(_pruned, "trajectory string, actions array<string>, removed int")
    return found.select(F.col("trajectory").cast(steps.schema[trajectory].dataType).alias(trajectory), "actions", "removed")


def hill(rows: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, distinct items and hill, the exponential of their entropy. Counts combine before each shuffle."""
    counts = rows.groupBy(*by, item).agg(F.count(F.lit(1)).alias("c"))
    # with N = sum of c: entropy = ln N - (sum of c ln c) / N
    total, spread = F.sum("c"), F.sum(F.col("c") * F.log("c"))
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("unique_items"), total.alias("total"), F.exp(F.log(total) - spread / total).alias("hill"))


def effective_diversity(episodes: DataFrame, by: list[str], raw: str = "raw_key", effective: str = "effective_key") -> DataFrame:
    """Per group: counts of episodes, valid ones and successes, and unique and effective numbers of ways over both.

    episodes: is_valid, is_success, the two keys and removed (steps that pruning took away).
    """
    counted = episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episode_count"), F.count_if("is_valid").alias("valid_episode_count"), F.count_if("is_success").alias("success_count"),
        F.count_if(F.col("is_success") & (F.col("removed") > 0)).alias("changed_success_trajectories"), F.coalesce(F.sum(F.when(F.col("is_success"), F.col("removed"))), F.lit(0)).alias("removed_actions"),
    )
    won = episodes.where("is_success")
    for name, key in (("raw", raw), ("effective", effective)):
        found = hill(won, by, key).select(*(F.col(b).alias(f"_{b}") for b in by), F.col("unique_items").alias(f"{name}_unique"), F.col("hill").alias(f"{name}_hill"))
        counted = counted.join(found, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], "left").drop(*(f"_{b}" for b in by))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    valid, success = F.greatest("valid_episode_count", F.lit(1)), F.greatest("success_count", F.lit(1))
    ratios = {f"{n}_{m}": zero(f"{n}_{c}") / of for n in ("raw", "effective") for m, c, of in (("esd", "unique", valid), ("h_esd", "hill", valid), ("wsd", "unique", success), ("h_wsd", "hill", success))}
    return counted.withColumns({f"{n}_unique": F.coalesce(F.col(f"{n}_unique"), F.lit(0)) for n in ("raw", "effective")} | {f"{n}_hill": zero(f"{n}_hill") for n in ("raw", "effective")}).withColumns(ratios)


def metric_rollup(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation (0 for one run) and number of runs."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"), F.count(value).alias("runs"))


def strategy_summary(episodes: DataFrame, by: list[str], key: str = "strategy") -> DataFrame:
    """Per group: success rates over all and over not aborted episodes, ways per episode, and the commonest way's share."""
    base = episodes.groupBy(*by).agg(F.count(F.lit(1)).alias("trajectory_count"), F.count_if(~F.col("aborted")).alias("non_aborted_count"), F.count_if("is_success").alias("success_count"))
    counts = episodes.where("is_success").groupBy(*by, key).agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy(*by).agg(F.max("c").alias("top"), F.count(F.lit(1)).alias("ways"), F.exp(F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("effective_ways"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = lambda a, b: F.when(F.col(b) > 0, n(a) / F.col(b)).otherwise(0.0)
    found = base.join(top, by, "left")
    return found.select(
        *by, "trajectory_count", "non_aborted_count", "success_count", n("ways").alias("unique_strategies"), per("success_count", "trajectory_count").alias("success_rate"),
        per("success_count", "non_aborted_count").alias("success_rate_non_aborted"), per("ways", "trajectory_count").alias("esd"), per("effective_ways", "trajectory_count").alias("h_esd"),
        per("ways", "success_count").alias("wsd"), per("effective_ways", "success_count").alias("h_wsd"), per("top", "success_count").alias("top1_share"),
    )


#: The rule by which the ways of each benchmark are pruned.
RULES = {"babyai": "babyai_turn_noise", "babaisai": "babaisai_noop_loop_prune"}


def run_diversity(episodes: DataFrame, steps: DataFrame, by: list[str], rule: str = "babyai_turn_noise") -> DataFrame:
    """effective_diversity of runs (the columns `by`) from their episodes and steps: raw ways against those that the rule leaves.

    episodes: trajectory_id, is_valid and is_success (of valid ones) and `by`. Successes without steps count as episodes, but have no
    way. Each relation meets the other once.
    """
    raw = sequences(steps, "turn_action" if rule == "babyai_turn_noise" else "action").select("trajectory_id", F.to_json("actions").alias("raw_key"), F.size("actions").alias("_n"))
    left = ways(steps, rule).select("trajectory_id", F.to_json(F.filter("actions", lambda a: a.isNotNull())).alias("effective_key"), F.size(F.filter("actions", lambda a: a.isNotNull())).alias("_m"))
    won = F.col("is_valid") & F.col("is_success")
    rows = episodes.withColumn("is_success", won).join(raw, "trajectory_id", "left").join(left, "trajectory_id", "left")
    rows = rows.withColumns({"removed": F.coalesce(F.col("_n") - F.col("_m"), F.lit(0)), "raw_key": F.when(won, F.col("raw_key")), "effective_key": F.when(won, F.col("effective_key"))})
    return effective_diversity(rows, by)
