"""Files that a trainer reads: pairs and supervised rows as JSON lines, each line held to its rules, faults named by file and line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.casts import strip
from .artifacts import json_fault
from .strict_lines import numbered

#: Fields that a pair needs, those of its two sides, and those of a balanced pair besides.
PAIR, SIDE, BALANCED = ["pair_type", "prompt", "chosen", "rejected"], ["action_text", "success"], ["pair_weight", "chosen_target_prob"]
TYPES = ("win_lose", "win_win")
KINDS = ("pair", "balanced_pair", "sft")


def _missing(v: Column, names: list[str]) -> Column:
    lacking = F.filter(F.array(*(F.when(V.field(v, n).isNull(), n) for n in names)), lambda n: n.isNotNull())
    return V.let(lacking, lambda m: F.when(F.size(m) > 0, F.concat(F.lit("missing required fields: "), F.array_join(m, ", "))))


def _is_text(v: Column) -> Column:
    return V.let(v, lambda x: F.coalesce((V.kind(x) == "STRING") & (strip(V.plain(x)) != ""), F.lit(False)))


def _side_fault(v: Column, side: str) -> Column:
    def read(x: Column) -> Column:
        lacking = V.let(_missing(x, SIDE), lambda m: F.when(m.isNotNull(), F.concat(F.lit(f"{side}: "), m)))
        return F.when(~V.is_object(x), f"{side} must be an object").otherwise(F.coalesce(lacking, F.when(~_is_text(V.field(x, "action_text")), f"{side}.action_text must be a text that isn't empty")))

    return V.let(V.field(v, side), read)


def _number_fault(v: Column, name: str, low: float, high: float | None, needed: bool) -> Column:
    """A finite number within bounds; above 0 where there is no upper one."""

    def read(x: Column) -> Column:
        n = V.number(x)
        fits = V.let(n, lambda k: F.coalesce(~F.isnan(k) & (F.abs(k) != float("inf")) & ((k > low) if high is None else k.between(low, high)), F.lit(False)))
        return F.when(x.isNull(), F.lit(f"missing required fields: {name}") if needed else F.lit(None)).when(~fits, f"{name} must be {'above 0' if high is None else 'in [0, 1]'}")

    return V.let(V.field(v, name), read)


def _messages_fault(v: Column, name: str, roles: tuple[str, ...] = ()) -> Column:
    def one(m: Column, i: Column) -> Column:
        spot = F.concat(F.lit(f"{name}["), (i + 1).cast("string"), F.lit("] "))
        said = lambda k: V.let(V.field(m, k), lambda x: F.when(F.coalesce(V.truth(x), F.lit(False)), strip(V.text(x))).otherwise(""))
        role = V.let(said("role"), lambda r: F.when(r == "", "must contain a role and a content").when(~r.isin(*roles) if roles else F.lit(False), f"must have one of the roles {', '.join(roles)}"))
        return V.let(F.when(~V.is_object(m), "must be an object").when(said("content") == "", "must contain a role and a content").otherwise(role), lambda w: F.when(w.isNotNull(), F.concat(spot, w)))

    def read(x: Column) -> Column:
        every = V.items(x)
        first = F.try_element_at(F.filter(F.transform(every, one), lambda w: w.isNotNull()), F.lit(1))
        return F.when(x.isNull(), f"missing required fields: {name}").when(F.coalesce(F.size(every), F.lit(0)) <= 0, f"{name} must be a list that isn't empty").otherwise(first)

    return V.let(V.field(v, name), read)


def fault(v: Column, kind: str, pair_type: str | None = None) -> Column:
    """What is wrong with an object of this kind; null if nothing is. pair_type: the only type that a file may hold."""
    if kind == "sft":
        return F.coalesce(_messages_fault(v, "prompt"), _messages_fault(v, "completion", ("assistant",)))
    if kind not in KINDS:
        raise ValueError(f"no kind {kind}")
    balanced = kind == "balanced_pair"
    own = V.let(V.field(v, "pair_type"), V.text)
    allowed = [pair_type] if pair_type else list(TYPES)
    of_type = V.let(own, lambda t: F.when(~t.isin(*allowed), F.concat(F.lit("pair_type "), t, F.lit(f" is not {' or '.join(allowed)}"))))
    numbers = [_number_fault(v, "pair_weight", 0.0, None, True)] if balanced else []
    numbers.append(_number_fault(v, "chosen_target_prob", 0.0, 1.0, balanced))
    return F.coalesce(_missing(v, PAIR + (BALANCED if balanced else [])), F.when(~_is_text(V.field(v, "prompt")), "prompt must be a text that isn't empty"), _side_fault(v, "chosen"), _side_fault(v, "rejected"), *numbers, of_type)


def judged(spark: SparkSession, paths: str | list[str], kind: str, pair_type: str | None = None) -> DataFrame:
    """file, line, v (the object) and reason (null: none) of each line that isn't blank."""
    rows = numbered(spark, paths).withColumns({"v": F.try_parse_json("text"), "_fault": json_fault("text")})
    unread = F.when(F.col("v").isNull(), "invalid JSON: a key twice or no number")
    return rows.withColumn("reason", F.coalesce("_fault", unread, fault(F.col("v"), kind, pair_type))).drop("_fault", "text")


def faults(spark: SparkSession, paths: str | list[str], kind: str, pair_type: str | None = None) -> DataFrame:
    """file, line and reason of each line that a trainer can't take."""
    return judged(spark, paths, kind, pair_type).where("reason is not null").select("file", "line", "reason")


def read(spark: SparkSession, paths: str | list[str], kind: str, pair_type: str | None = None) -> DataFrame:
    """What a trainer reads: prompt, chosen, rejected, pair_type, target_prob (1 if unsaid) and weight of pairs, or prompt and
    completion (messages) of supervised rows. A ValueError names the first fault, or says that there are no rows."""
    rows = judged(spark, paths, kind, pair_type)
    if bad := rows.where("reason is not null").orderBy("file", "line").first():
        raise ValueError(f"{bad['file']}:{bad['line']} {bad['reason']}")
    if rows.isEmpty():
        raise ValueError(f"no rows in {paths}")
    v = F.col("v")
    if kind == "sft":
        message = lambda m: F.struct(strip(V.text(V.field(m, "role"))).alias("role"), strip(V.text(V.field(m, "content"))).alias("content"))
        return rows.select(*(F.transform(V.items(V.field(v, c)), message).alias(c) for c in ("prompt", "completion")))
    side = lambda s: V.plain(V.field(v, f"{s}.action_text")).alias(s)
    target = F.coalesce(V.number(V.field(v, "chosen_target_prob")), F.lit(1.0)).alias("target_prob")
    return rows.select(V.plain(V.field(v, "prompt")).alias("prompt"), side("chosen"), side("rejected"), V.plain(V.field(v, "pair_type")).alias("pair_type"), target, V.number(V.field(v, "pair_weight")).alias("weight"))
