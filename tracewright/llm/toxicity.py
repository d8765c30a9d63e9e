"""Toxicity by maximum-scoring segments.

Each token scores its log-odds between toxic and other labelled texts, smoothed by a Dirichlet prior in proportion to the
token's count in all documents (counts are of documents). A word scores as the best of itself and its first 3 to 8
letters, so that stems are known under any ending; words whose log-odds are not significant score a small constant below
0. One linear scan
finds all maximal segments of a text (those that no longer one beats). Extreme-value statistics turn a segment's score
and the text's length into the chance of such a segment in harmless text; the evidence of the significant
segments, against that chance, goes through a logistic function fitted on labelled texts that the lexicon has not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, expm1, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Memo, cut, map_texts, slices
from .quality import fold, platt, sampled

#: Labelled rows of each class that log-odds are learnt from, at most, and bytes of their texts, half of them for each class: of
#: more, rows are taken in the order of the sample. The prior counts all documents.
SAMPLE, SAMPLE_BYTES = 8_000, 256 << 20
#: The least z-score and the least count in toxic texts of a token of the lexicon. What the driver gathers are the units of
#: the sample with that count: a word has 7 units at most, and a unit takes that many words, so they are fewer than 7/3 of the words
#: of SAMPLE_BYTES / 2 bytes of toxic text, whatever the number of documents and labels.
LEAST_Z, LEAST_COUNT = 4.0, 3
#: Tokens that the prior is worth, and what a token outside the lexicon scores.
PRIOR, GAP = 5_000.0, -0.08
#: A segment is significant if harmless text of that length holds one in fewer than this many cases.
SIGNIFICANT = 0.05
#: Words that a memo of their worth holds, and distinct words counted before their units are.
MOST_COUNTED, MOST_WORDS = 400_000, 100_000

tokens = re.compile(r"[^\W\d_]+").findall


def units(word: str) -> list[str]:
    """What a word is known by: itself, and its beginnings, marked by a hyphen."""
    return [word, *(f"{word[:k]}-" for k in range(3, min(9, len(word))))]


class Beginnings:
    """Whether a word can be known by any of these units: a look at its first letters, for the many that aren't."""

    def __init__(self, known: Iterable[str]):
        letters = [u.removesuffix("-") for u in known]
        self.three, self.four = {x[:3] for x in letters if len(x) <= 3}, {x[:4] for x in letters if len(x) > 3}

    def of(self, words: Iterable[str]) -> list[str]:
        three, four = self.three, self.four
        return [w for w in words if w[:4] in four or w[:3] in three]


def of_units(words: Counter) -> Counter:
    """Counts of units from counts of words; '' has the sum over words."""
    found = Counter()
    for w, n in words.items():
        for u in units(w):
            found[u] += n
    if words:
        found[""] = words.total()
    return found


def segments(hits: list[tuple[int, float]], gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score), in order; hits: positions with positive scores.

    Positions between hits score `gap` each. Linear: each step either adds a segment or joins some that are never looked at
    again.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before first, sum up to last
    total, at = 0.0, 0
    for i, s in hits:
        left = total + gap * (i - at)
        total, at = left + s, i + 1
        first, low, high = i, left, total
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k -= 1
            if k < 0 or found[k][3] >= high:
                found.append((first, i, low, high))
                break
            first, low = found[k][0], found[k][2]
            del found[k:]
    return [(a, b, high - low) for a, b, low, high in found]


@dataclass
class Model:
    lexicon: dict[str, float]
    decay: float = 1.0  # lambda of the extreme-value law
    rate: float = 0.1  # its K
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        self.worth = Memo(self._worth, MOST_COUNTED)
        self.known = Beginnings(self.lexicon)

    def __reduce__(self):
        return Model, (self.lexicon, self.decay, self.rate, self.slope, self.offset)

    def _worth(self, word: str) -> float | None:
        return max((s for u in units(word) if (s := self.lexicon.get(u)) is not None), default=None)

    def find(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens, and the maximal segments of their scores."""
        words, worth, three, four = tokens(text.lower()), self.worth, self.known.three, self.known.four
        return len(words), segments([(i, s) for i, w in enumerate(words) if (w[:4] in four or w[:3] in three) and (s := worth[w]) is not None])

    def chance(self, score: float, n: int) -> float:
        """That n tokens of harmless text hold a segment of this score."""
        return -expm1(-self.rate * n * exp(-min(self.decay * score, 700)))

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant segments as (first token, last token, chance)."""
        n, found = self.find(text)
        return [(a, b, p) for a, b, s in found if (p := self.chance(s, n)) < SIGNIFICANT]

    def evidence(self, text: str) -> float:
        n, found = self.find(text)
        return evidence(self, n, [s for _, _, s in found])

    def score(self, text: str) -> float:
        return 1 / (1 + exp(-max(-30.0, min(30.0, self.slope * self.evidence(text) + self.offset))))


def _labelled(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """key, _label, text and aside (kept for calibration) of the labelled sample, read once; SAMPLE_BYTES of text at most.

    The driver looks at key and size of each, 2 * SAMPLE rows.
    """
    own = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = cut(own.join(F.broadcast(chosen), key).withColumn("aside", F.pmod(F.xxhash64(F.lit("aside"), F.col(key)), F.lit(5)) == 0))
    sizes = rows.groupBy(key, "_label").agg(F.sum(F.octet_length("text")).alias("b"), F.xxhash64(key).alias("o")).collect()
    if sum(r["b"] for r in sizes) <= SAMPLE_BYTES:
        return rows
    left, stay = {0: SAMPLE_BYTES // 2, 1: SAMPLE_BYTES // 2}, []
    for r in sorted(sizes, key=lambda r: (r["o"], r[key])):
        left[r["_label"]] -= r["b"]
        if left[r["_label"]] >= 0:
            stay.append((r[key],))
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame(stay, StructType([rows.schema[key]]))), key)


def _labelled_counts(rows: DataFrame) -> DataFrame:
    """word, y (in toxic texts to learn from) and z (in others to learn from); the word '' has the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other = Counter(), Counter()

        def out() -> pa.RecordBatch:
            y, z = of_units(toxic), of_units(other)
            words = list(y.keys() | z.keys())
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "y": pa.array([y[w] for w in words], pa.int64()), "z": pa.array([z[w] for w in words], pa.int64())})

        for part in slices(batches, "text"):
            for label, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                (toxic if label else other).update(set(tokens(x.lower())))
            if len(toxic) + len(other) > MOST_WORDS:
                yield out()
                toxic.clear()
                other.clear()
        if toxic or other:
            yield out()

    found = rows.select("_label", "text").mapInArrow(run, "word string, y bigint, z bigint").groupBy("word")
    return found.agg(F.sum("y").alias("y"), F.sum("z").alias("z"))


def _all_counts(docs: DataFrame, words: list[str], text: str) -> tuple[np.ndarray, int]:
    """Of each of these units, how many words of all documents are known by it, and how many words there are (each once a document).

    The units are all those of a sample with some least count. Every document is counted; a partition gives one row of counts, so that what shuffles doesn't grow with the texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, Beginnings(words)))
    n = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known, seen, count = sent.value[0].get, sent.value[1].of, Counter(), [0] * (n + 1)

        def add() -> None:
            """A beginning that isn't asked for has no longer one that is: each stands for no more words of a sample than those before it."""
            for w, k in seen.items():
                if (at := place(w)) is not None:
                    count[at] += k
                for end in range(3, min(9, len(w))):
                    if (at := place(f"{w[:end]}-")) is None:
                        break
                    count[at] += k
            seen.clear()

        for part in slices(batches, "text"):
            for x in part.column(0).to_pylist():
                words = set(tokens((x or "").lower()))
                count[n] += len(words)
                seen.update(known(words))
            if len(seen) > MOST_WORDS:
                add()
        add()
        found = np.array(count, np.int64)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], names=["i", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(n + 1, np.int64)
    for r in rows:
        count[r["i"]] = r["n"]
    return count[:n], int(count[n])


def fit(docs: DataFrame, labels: DataFrame, label: str, trains: Column, most: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """A model of labels[label] from the rows where `trains` holds, `most` of each class and SAMPLE_BYTES of text at most.

    Labels other than 0 and 1 and null keys are left out. Of a key with several texts, one is judged for calibration. Without
    both classes, every text scores the share of label 1 (1/2 without labels). Null texts count as empty.
    """
    every = labels.where(trains & F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).count().collect()
    share = {r["y"]: r["count"] for r in every}
    if len(share) < 2:
        p = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
        return Model({}, slope=0.0, offset=log(p / (1 - p)))
    rows = _labelled(docs, sampled(labels, label, trains, most, key), key, text)
    counted = _labelled_counts(rows.where("not aside")).where((F.col("y") >= LEAST_COUNT) | (F.col("word") == "")).collect()
    sums = next(((r["y"], r["z"]) for r in counted if not r["word"]), (0, 0))
    counted = sorted((r["word"], r["y"], r["z"]) for r in counted if r["word"])  # bounded by the sample's bytes
    of_all, n = _all_counts(docs, [r[0] for r in counted], text)
    weigh = log_odds(np.array([r[1] for r in counted], float), np.array([r[2] for r in counted], float), of_all, *(max(1, x) for x in (*sums, n)))
    model = Model({counted[i][0]: float(weigh.score[i]) for i in weigh.chosen})
    background = weigh.background[weigh.chosen]
    model.decay = decay(weigh.score[weigh.chosen], background)
    # one text a key, and of each a few numbers
    judged = rows.where("aside").groupBy(key).agg(F.max("_label").alias("_label"), F.min("text").alias("text"))
    low = log(20) / model.decay
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def seen():
        def work(texts: list[str]) -> dict[str, list]:
            got = [sent.value.find(x) for x in texts]
            return {"n": [n for n, _ in got], "high": [sum(s >= low for _, _, s in found) for _, found in got]}

        return work

    clean = map_texts(judged.where("_label = 0"), seen, [], "n bigint, high bigint").agg(F.sum("n"), F.sum("high")).first()
    model.rate = min(1.0, max(0.01, ((clean[1] or 0) + 0.5) / max(1, clean[0] or 0) * exp(model.decay * low)))
    own = docs.sparkSession.sparkContext.broadcast(model)
    found = map_texts(judged, lambda: lambda texts: {"x": [own.value.evidence(t) for t in texts]}, ["_label"], "x double").collect()  # 2 * SAMPLE rows at most
    if len({r["_label"] for r in found}) < 2:
        model.slope, model.offset = 2.0, -2.0
        return model
    x, label_of = np.array([r["x"] for r in found]), np.array([r["_label"] for r in found])
    by = np.lexsort((label_of, x))
    x, label_of = x[by], label_of[by]
    counts = {c: (label_of == c).sum() for c in (0, 1)}
    weight = np.where(label_of == 1, share[1] / counts[1], share[0] / counts[0]) / sum(share.values()) * len(found)
    model.slope, model.offset = platt(x, label_of, weight)
    return model


@dataclass
class LogOdds:
    score: np.ndarray
    background: np.ndarray  # share of harmless words that a unit stands for
    chosen: np.ndarray  # places of the significant ones


def log_odds(y: np.ndarray, z: np.ndarray, n: np.ndarray, all_y: int, all_z: int, all_n: int) -> LogOdds:
    """Log-odds between toxic (y) and other (z) texts with a Dirichlet prior in proportion to the counts in all documents (n)."""
    prior = PRIOR * n / all_n
    odds = lambda c, of: np.log((c + prior) / (of + PRIOR - c - prior))
    score = odds(y, all_y) - odds(z, all_z)
    error = np.sqrt(1 / (y + prior) + 1 / (z + prior))
    return LogOdds(score, (z + prior) / (all_z + PRIOR), np.flatnonzero((score > 0) & (score / error >= LEAST_Z)))


def evidence(model: Model, n: int, scores: list[float]) -> float:
    """Powers of ten against chance: of the best segment, and half as much of the other significant ones."""
    powers = sorted((-log(max(model.chance(s, n), 1e-300)) / log(10) for s in scores), reverse=True)
    least = -log(SIGNIFICANT) / log(10)
    return min(powers[0] + 0.5 * sum(p for p in powers[1:] if p > least), 60.0) if powers else 0.0


def decay(score: np.ndarray, background: np.ndarray) -> float:
    """The lambda for which the mean of exp(lambda * score) over harmless tokens is 1."""
    rest = 1 - background.sum()
    mean = lambda x: float((background * np.exp(np.minimum(x * score, 600))).sum() + rest * exp(GAP * x))
    low, high = 1e-3, 1.0
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return max(0.05, low)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """docs[keep] with score and passages (first and last token and chance of each significant segment)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts: list[str]) -> dict[str, list]:
            found = [sent.value.find(x) for x in texts]
            m = sent.value
            powers = [evidence(m, n, [s for _, _, s in got]) for n, got in found]
            scores = [1 / (1 + exp(-max(-30.0, min(30.0, m.slope * e + m.offset)))) for e in powers]
            spans = [[{"first": a, "last": b, "chance": p} for a, b, s in got if (p := m.chance(s, n)) < SIGNIFICANT] for n, got in found]
            return {"score": scores, "passages": spans}

        return work

    return map_texts(docs, make, keep, "score double, passages array<struct<first: bigint, last: bigint, chance: double>>", text)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3, most: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, held_out, score, predicted, passages; learnt from the labels of the other folds alone.

    A null or empty text has no segments. A null key is not held out and never learnt from. Repeated rows give repeated rows;
    an empty table an empty one.
    """
    model = fit(docs, labels, label, fold(key, folds) != held, most, key=key)
    found = score(docs, model, [key])
    return found.select(key, F.coalesce(fold(key, folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
