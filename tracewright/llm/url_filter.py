"""URL filter: rules first, then the ratio of two character language models, in DataFrame operations alone.

The models are variable-order Markov models of order ORDER, one of the URLs that the rules allow and one of those they
block, smoothed from order to order: P_k(c | h) = (n(hc) + STRENGTH * P_k-1(c | h')) / (n(h) + STRENGTH), P_0 uniform. A URL's
value is the mean over its characters of the log ratio; the threshold is the one that parts labelled URLs which the models
have not seen best. All labelled URLs count: no sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

ORDER, STRENGTH, ALPHABET = 4, 4.0, 128
PAD = "\x02"
#: A gram with over 1/HOT of all positions meets its score by broadcast (so HOT rows at most), the others by a shuffle.
HOT = 2_000
#: One in FOLDS labelled URLs is for the threshold.
FOLDS = 4
#: Bins of the values that the threshold is chosen from.
BINS = 4_000


def host_path(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and all after the scheme; '' for null or without '://'."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path, rest


def matched(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """Number of the longest rule that fits, or null. A rule is a host and the start of a path."""
    found = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: len(rules[k][1])):
        name, slash, rest = rules[k][1].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(k)).otherwise(found)
    return found


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """A row per character of s: it and the ORDER characters before it."""
    padded = F.concat(F.lit(PAD * ORDER), "s", F.lit(PAD))
    return rows.select(*keep, padded.alias("p")).select(*keep, F.explode(F.expr(f"transform(sequence(1, char_length(p) - {ORDER}), i -> substr(p, i, {ORDER + 1}))")).alias("gram"))


def _suffixes(grams: DataFrame, *keep: str) -> DataFrame:
    """Each gram by order: context (its last j characters before the last) and character."""
    orders = F.array(*(F.struct(F.lit(j).alias("j"), F.substring("gram", ORDER - j + 1, j).alias("context")) for j in range(1, ORDER + 1)))
    return grams.select(*keep, "gram", F.substring("gram", ORDER + 1, 1).alias("c"), F.explode(orders).alias("o")).select(*keep, "gram", "c", "o.j", "o.context")


def models(labelled: DataFrame) -> DataFrame:
    """context, totals and a map from character to counts, for both models; labelled: s, allowed."""
    n = lambda yes: F.count(F.when(F.col("allowed") == yes, 1))
    grams = _grams(labelled, "allowed").groupBy("gram").agg(n(True).alias("a"), n(False).alias("b"))
    counts = _suffixes(grams, "a", "b").groupBy("context", "c").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # a context has no more entries than the alphabet
    return counts.groupBy("context").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.map_from_entries(F.collect_list(F.struct("c", F.struct("a", "b")))).alias("next"))


def ratios(grams: DataFrame, model: DataFrame) -> DataFrame:
    """grams (each once, with n) and ratio, the log of the two models' probabilities of its last character."""
    met = _suffixes(grams, "n").join(model, "context", "left")
    got = F.element_at("next", F.col("c"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    entry = F.struct("j", zero(got["a"]).alias("a"), zero(got["b"]).alias("b"), zero(F.col("ta")).alias("ta"), zero(F.col("tb")).alias("tb"))
    every = met.groupBy("gram", "n").agg(F.array_sort(F.collect_list(entry)).alias("o"))  # ORDER entries
    start = F.struct(F.lit(1.0 / ALPHABET).alias("p"), F.lit(1.0 / ALPHABET).alias("q"))
    step = lambda s, x: F.struct(((x["a"] + s["p"] * STRENGTH) / (x["ta"] + STRENGTH)).alias("p"), ((x["b"] + s["q"] * STRENGTH) / (x["tb"] + STRENGTH)).alias("q"))
    return every.select("gram", "n", F.aggregate("o", start, step, lambda s: F.log(s["p"] / s["q"])).alias("ratio"))


def values(rows: DataFrame, model: DataFrame) -> DataFrame:
    """row and value, the mean log ratio over the characters of s."""
    grams = _grams(rows, "row")
    scored = cut(ratios(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), model))
    total = scored.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(scored.where(F.col("n") * HOT > total).select("gram", F.col("ratio").alias("hot")))
    marked = grams.join(hot, "gram", "left")
    per_row = lambda d, ratio: d.groupBy("row").agg(F.sum(ratio).alias("t"), F.count(F.lit(1)).alias("k"))
    often = per_row(marked.where("hot is not null"), "hot")
    rest = per_row(marked.where("hot is null").select("row", "gram").join(scored.where(F.col("n") * HOT <= total), "gram"), "ratio")
    return often.unionByName(rest).groupBy("row").agg((F.sum("t") / F.sum("k")).alias("value"))


def threshold(valued: DataFrame) -> float:
    """The value that parts labelled rows best (mean of the two classes' shares), 0 if it does; 0 without both classes."""
    at = F.floor(F.least(F.greatest("value", F.lit(-10.0)), F.lit(10.0)) * (BINS / 20))
    rows = valued.groupBy(at.alias("bin")).agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("b")).orderBy("bin").collect()  # BINS rows at most
    a, b = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not a or not b:
        return 0.0
    best, found, below_a, below_b, edge = 0.0, [], 0, 0, -10.0
    for r in rows:  # thresholds between the rows so far and this one all part them alike
        gain, start = below_b / b + 1 - below_a / a, r["bin"] * 20 / BINS
        if gain > best + 1e-12:
            best, found = gain, []
        if gain > best - 1e-12:
            found.append((edge, start))
        below_a, below_b, edge = below_a + r["a"], below_b + r["b"], (r["bin"] + 1) * 20 / BINS
    low, high = max(found, key=lambda x: (x[0] <= 0 <= x[1], x[1] - x[0]))
    return 0.0 if low <= 0 <= high else (low + high) / 2


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of pages: key, host, path, rule (or null), verdict, value.

    rules: (allow or block, host and start of the path). A rule's verdict holds; else a URL is allowed if its value, less the
    threshold, is not negative. What the models read is the URL behind its scheme, A-Z lower-cased, with every digit as 0. Null URLs and those without '://' have the empty host and path, fit no rule and are
    judged as the empty string is. Without labelled URLs of both kinds, ratios are what the one model gives. Repeated rows
    give repeated rows; an empty table an empty one; other columns are left out.
    """
    host, path, rest = host_path(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select(F.monotonically_increasing_id().alias("row"), "key", host.alias("host"), path.alias("path"), F.regexp_replace(ascii_lower(rest), "[0-9]", "0").alias("s"))
    allowed = F.array(*(F.lit(v == "allow") for v, _ in rules))
    rows = rows.withColumn("k", matched(rules, F.col("host"), F.col("path")))
    rows = cut(rows.withColumn("allowed", F.when(F.col("k").isNotNull(), allowed[F.col("k")])).withColumn("aside", F.pmod(F.xxhash64("s"), F.lit(FOLDS)) == 0))
    labelled = rows.where("k is not null")
    model = cut(models(labelled.where("not aside").select("s", "allowed")))
    valued = cut(values(rows.where("k is null or aside").select("row", "s"), model))
    best = threshold(labelled.where("aside").select("row", "allowed").join(valued, "row"))
    names = F.array(*(F.lit(r) for _, r in rules))
    verdict = F.when(F.coalesce("allowed", F.col("value") - best >= 0), "allow").otherwise("block")
    found = rows.join(valued, "row", "left")
    return found.select(F.col("key").alias(key), "host", "path", F.when(F.col("k").isNotNull(), names[F.col("k")]).alias("rule"), verdict.alias("verdict"), (F.col("value") - best).alias("value"))
