"""Quality classifier by naive Bayes support vectors.

Features are indicators of n-grams (1 to 3) over the shapes of a text's words: the case pattern, the digits and the marks of
a word, how long it is, and whether it repeats the word before. Each indicator is scaled by the log-count ratio of the two
classes; a linear hinge-loss model is fitted by dual coordinate descent, and its margin is turned into a score between
0 and 1 by a logistic function fitted on a part of the sample that the model has not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Memo, cut, map_arrow, map_texts, per_worker, slices

BITS = 18
DIM = 1 << BITS
#: Labelled rows of each class that a model is fitted on, at most. The only bound on what is learnt from.
SAMPLE = 8_000
#: Bytes of their features (4 each) at most, half of them for each class: of more, rows are taken in the order of the sample.
SAMPLE_BYTES = 256 << 20
MOST_WORDS = 150_000
#: Longer words, as in texts without white space, count as consecutive pieces of so many characters.
PIECE = 64

_upper, _lower, _digits, _marks = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+"), re.compile(r"([^\w])\1+")


def shape(word: str) -> str:
    """Letters as A or a, digits as 0, runs of one mark as two of it, and the length in classes; of the whole piece."""
    s = _marks.sub(r"\1\1", word)
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in s)
    s = re.sub(r"([Aa0])\1+", r"\1", s)
    n = len(word)
    return f"{s}:{0 if n < 4 else 1 if n < 9 else 2 if n < 17 else 3}"


def pieces(text: str) -> list[str]:
    """The words of a text, long ones in consecutive pieces; nothing is left out."""
    words = text.split()
    if words and len(max(words, key=len)) > PIECE:
        return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def code(word: str) -> int:
    """A word's digest (high half) and its shape's (low half)."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass"))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@per_worker
def codes() -> Memo:
    """One per worker process."""
    return Memo(code, MOST_WORDS)


def features(texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of text number and feature, each once, ordered by both."""
    split = [pieces(x) for x in texts]
    n = [len(s) for s in split]
    total = sum(n)
    codes = np.fromiter((memo[w] for s in split for w in s), np.uint64, total)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), n)
    one = codes & np.uint64(0xFFFFFFFF)
    if total > 1:
        one[1:][(codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])] += np.uint64(1 << 33)
    one = mix(one + np.uint64(1))
    found, gram = [doc << BITS | (one >> np.uint64(64 - BITS)).astype(np.int64)], one
    for k in (1, 2):
        if total <= k:
            break
        gram = mix(gram[:-1] * np.uint64(0xD6E8FEB86659FD93) + one[k:])
        whole = doc[:-k] == doc[k:]
        found.append(doc[:-k][whole] << BITS | (gram[whole] >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & (DIM - 1)


@dataclass
class Model:
    weight: np.ndarray  # of each feature, the ratio's scale within
    bias: float
    slope: float
    offset: float

    def margins(self, texts: list[str], memo: Memo) -> np.ndarray:
        doc, feature = features(texts, memo)
        return np.bincount(doc, self.weight[feature], minlength=len(texts)) + self.bias

    def scores(self, texts: list[str], memo: Memo) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts, memo) + self.offset, -30, 30)))


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(DIM, alpha), np.full(DIM, alpha)
    for x, y in zip(rows, label, strict=True):
        (p if y else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, label: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7, tol: float = 1e-3) -> np.ndarray:
    """Weights of the scaled features and, last, of a constant one: L1-loss SVM by dual coordinate descent."""
    w, alpha = np.zeros(DIM + 1), np.zeros(len(rows))
    sign = np.where(label, 1.0, -1.0)
    values = [np.append(scale[x], 1.0) for x in rows]
    index = [np.append(x, DIM) for x in rows]
    norm = np.array([v @ v for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            at, v = index[i], values[i]
            slack = sign[i] * (w[at] @ v) - 1
            step = min(slack, 0) if alpha[i] == 0 else max(slack, 0) if alpha[i] == cost[i] else slack
            if step:
                worst = max(worst, abs(step))
                new = min(max(alpha[i] - slack / norm[i], 0), cost[i])
                w[at] += (new - alpha[i]) * sign[i] * v
                alpha[i] = new
        if worst < tol:
            break
    return w


def platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic function that fits labels best, by damped Newton steps."""
    scale = max(float(np.std(margin)), 1e-9)
    x = np.stack([margin / scale, np.ones_like(margin)], 1)
    total = lambda y: max(weight[label == y].sum(), 1e-9)
    target = np.where(label == 1, (total(1) + 1) / (total(1) + 2), 1 / (total(0) + 2))
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-6, x.T @ (weight * (p - target)))
        b -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0] / scale), float(b[1])


def sampled(labels: DataFrame, label: str, trains: Column, most: int, key: str = "doc_id") -> DataFrame:
    """Rows of labels to learn from, `most` of each class at most, by the order of a hash of the key."""
    rows = labels.where(trains & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    part = lambda y: rows.where(F.col("_label") == y).orderBy(F.xxhash64(key), key).limit(most)
    return part(0).unionByName(part(1))


def _within(made: DataFrame, key: str, most: int = SAMPLE_BYTES) -> DataFrame:
    """The rows of the sample up to `most` bytes of features. The driver looks at key and size of each, 2 * SAMPLE rows."""
    sizes = made.select(key, "_label", F.octet_length("x").alias("b"), F.xxhash64(key).alias("o")).collect()
    if sum(r["b"] for r in sizes) <= most:
        return made
    left, stay = {0: most // 2, 1: most // 2}, []
    for r in sorted(sizes, key=lambda r: (r["o"], r[key])):
        left[r["_label"]] -= r["b"]
        if left[r["_label"]] >= 0:
            stay.append((r[key],))
    kept = made.sparkSession.createDataFrame(stay, StructType([made.schema[key]]))
    return made.join(F.broadcast(kept), key)


def fit(docs: DataFrame, labels: DataFrame, label: str, trains: Column, most: int = SAMPLE, cost: float = 0.1, key: str = "doc_id", text: str = "text") -> Model:
    """A model of labels[label] from the rows where `trains` holds, `most` of each class and SAMPLE_BYTES of features at most.

    Of a key with several texts, one is learnt from. Rows without a text learn as empty ones; labels other than 0 and 1 are left out, as are null keys. Without both
    classes, the model scores every text with the share of label 1 (1/2 without labels).
    """
    chosen = F.broadcast(sampled(labels, label, trains, most, key))  # 2 * most rows
    every = labels.where(trains & F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).count().collect()
    share = {r["y"]: r["count"] for r in every}

    def make():
        memo = codes()

        def work(texts: list[str]) -> dict[str, list]:
            doc, feature = features(texts, memo)
            cuts = np.searchsorted(doc, np.arange(1, len(texts)))
            return {"x": [x.astype("<u4").tobytes() for x in np.split(feature, cuts)]}

        return work

    made = map_texts(docs.select(key, text).join(chosen, key).select(key, "_label", text), make, [key, "_label"], "x binary", text)
    made = cut(made.groupBy(key).agg(F.max("_label").alias("_label"), F.min("x").alias("x")))  # one text a key
    got = sorted((r[key], r["_label"], r["x"]) for r in _within(made, key).collect())
    y = np.array([r[1] for r in got], bool)
    if not len(got) or y.all() or not y.any():
        p = (share.get(1, 0) + 0.5) / (sum(share.values()) + 1)
        return Model(np.zeros(DIM), 0.0, 0.0, float(np.log(p / (1 - p))))
    rows = [np.frombuffer(r[2], "<u4").astype(np.int64) for r in got]
    aside = np.arange(len(rows)) % 5 == 0 if len(rows) >= 200 else np.zeros(len(rows), bool)
    use = np.flatnonzero(~aside)
    mine, own = [rows[i] for i in use], y[use]
    if own.all() or not own.any():
        aside[:], mine, own = False, rows, y
    scale = log_count_ratio(mine, own)
    w = dual_descent(mine, scale, own, np.full(len(mine), cost))
    weight, bias = (w[:DIM] * scale).astype(np.float32), float(w[DIM])
    judge = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
    margin = np.array([weight[rows[i]].sum() + bias for i in judge])
    counts = {c: max(1, int((y[judge] == c).sum())) for c in (0, 1)}
    weights = np.where(y[judge], share[1] / counts[1], share[0] / counts[0]) / sum(share.values()) * len(judge)
    return Model(weight, bias, *platt(margin, y[judge].astype(int), weights))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """docs[keep] and score; null and empty texts get the model's score of a text without features."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        memo = codes()
        return lambda texts: {"score": sent.value.scores(texts, memo)}

    return map_texts(docs, make, keep, "score double", text)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, whose score is at least the threshold.

    Null and empty texts have the score of a text without features. Repeated rows share their fate; columns may have any
    names; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = codes()
        for part in slices(batches, text):
            scores = sent.value.scores([x or "" for x in part.column(at).to_pylist()], memo)
            yield part.filter(pa.array(scores >= threshold))

    return map_arrow(docs, run, docs.schema)


def fold(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo `of`; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % of


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, threshold: float = 0.5, most: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, held_out, score, predicted; learnt from the labels of the other folds alone.

    A null key is not held out and never learnt from. Repeated rows give repeated rows; an empty table an empty one.
    """
    model = fit(docs, labels, label, fold(key, folds) != held, most, key=key)
    found = score(docs, model, [key])
    return found.select(key, F.coalesce(fold(key, folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
