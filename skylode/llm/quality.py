"""Quality grades by ordinal cumulative-link regression on hashed text features."""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import kept_in_worker, map_arrow, texts

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 10_000
#: Hash buckets of word features; the shape features come after them.
BUCKETS = 1 << 18
SHAPES = 12
#: Lengths in bytes of the beginnings of words that are features beside the words.
STEMS = (4, 5, 6)
#: Length that a document's vector of words is scaled to.
LENGTH = 10.0
#: Tokens that a worker keeps; beyond that it starts anew.
CACHE = 500_000
GRADES = 3
#: A document stays if the probability of the highest grade is this at least.
THRESHOLD = 0.75
#: Labelled documents of the sample in which a feature must occur to get a weight.
LEAST_DOCS = 15
SCHEMA = "doc_id long, expected_grade double, tail_probability double, grade int, kept boolean"


def grade(quality: str = "quality", toxic: str = "toxic"):
    """The ordinal rating that the labels give: 0 low quality, 1 good but toxic, 2 good. Null counts as 0."""
    good, bad = F.coalesce(F.col(quality), F.lit(0)), F.coalesce(F.col(toxic), F.lit(0))
    return F.when(good < 1, 0).when(bad > 0, 1).otherwise(2)


class Tokens(dict):
    """Token → its place in ``table``, which has each token's buckets (the word's and those of its beginnings) and shape."""

    WIDTH = 2 + len(STEMS)

    def __init__(self):
        super().__init__()
        self.table = array("i")

    def __missing__(self, token: str) -> int:
        row = self[token] = len(self)
        word = token.lower().strip(".,;:!?()[]{}\"'«»").encode("utf-8", "surrogatepass")
        # A checksum of a beginning goes on to the next; the word's own is the last.
        at, code, begins = 0, 0, []
        for n in STEMS:
            code = crc32(word[at:n], code)
            begins.append((code ^ 0x5BD1E995) % BUCKETS)
            at = n
        self.table.extend((crc32(word[at:], code) % BUCKETS, *begins, shape(token)))
        return row

    def rows(self, tokens: list[str]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
            self.table = array("i")
        at = [self[t] for t in tokens]  # this may make the table grow
        return np.frombuffer(self.table, np.intc).reshape(-1, self.WIDTH)[at]


def shape(token: str) -> int:
    """Which of ten forms a token has."""
    plain = token[:-1] if token[-1] in ".,;:!?" else token
    if plain.isalpha():
        letters, digits, marks = len(plain), 0, len(token) - len(plain)
    else:
        letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
        marks = len(token) - letters - digits
    if not letters:
        return 1 if digits and marks <= digits else 2 if marks == 1 else 3
    if letters > 1 and token.upper() == token:
        return 4 if marks < 2 else 5
    if marks >= 3:
        return 6
    if digits:
        return 7
    if letters > 24:
        return 8
    return 9 if token[0].isupper() else 0


def features(text: str, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of beginnings of words, logarithms of their counts, and the shares of shapes, repeats and distinct words (the last is 1 for no words)."""
    found = text.split()
    n = len(found)
    extra = np.zeros(SHAPES + 1, np.float32)
    if not n:
        extra[SHAPES] = 1
        return np.zeros(0, np.int64), np.zeros(0, np.float32), extra
    counted = Counter(found)
    rows = tokens.rows(list(counted))
    times = np.fromiter(counted.values(), np.int64, len(counted))
    buckets, place = np.unique(rows[:, :-1], return_inverse=True)
    often = np.bincount(place.ravel(), np.repeat(times, rows.shape[1] - 1))
    extra[:10] = np.bincount(rows[:, -1], times, minlength=10)[:10] / n
    extra[10] = sum(map(eq, found, islice(found, 1, None))) / n
    extra[11] = 1 - len(counted) / n
    return buckets, np.log1p(often).astype(np.float32), 4 * extra


@dataclass
class CumulativeLink:
    """P(grade <= k) = sigmoid(threshold_k - w.x), with one weight vector and increasing thresholds.

    ``rarity`` weighs each bucket by how few documents of the sample have it (0 where too few do); a
    document's weighed vector is scaled to one length.
    """

    rarity: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str, tokens: Tokens) -> float:
        buckets, value, extra = features(text, tokens)
        value = value * self.rarity[buckets]
        size = math.sqrt(float(value @ value))
        return float(value @ self.weights[buckets]) * (LENGTH / size if size else 0.0) + float(extra @ self.weights[BUCKETS:])

    def tail(self, found: list[str], tokens: Tokens) -> np.ndarray:
        """The grades' probabilities of each text."""
        return self.probabilities(np.array([self.score(x, tokens) for x in found], np.float64))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        below = _sigmoid(self.thresholds[None, :] - scores[:, None])
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], grades: np.ndarray, grade_count: int = GRADES, steps: int = 150, rate: float = 0.1, ridge: float = 2e-3) -> CumulativeLink:
    """Maximum likelihood with a ridge, by full-batch Adam, in blocks of documents.

    The thresholds are a first one and logarithms of the gaps, so they stay in order. Rare grades weigh
    more, by the root of their rarity. Without rows the weights are zero and the thresholds even.
    """
    thresholds = np.linspace(-1, 1, grade_count - 1)
    n, weights = len(rows), np.zeros(BUCKETS + SHAPES + 1, np.float32)
    if not n:
        return CumulativeLink(np.zeros(BUCKETS, np.float32), weights, thresholds)
    seen = np.zeros(BUCKETS, np.int64)
    for buckets, _, _ in rows:
        seen[buckets] += 1
    known = seen >= min(LEAST_DOCS, n)
    rarity = np.where(known, (np.log(n / np.maximum(seen, 1)) / 3) ** 2, 0)
    used = np.concatenate([np.flatnonzero(known), np.arange(BUCKETS, BUCKETS + SHAPES + 1)])
    at = np.zeros(BUCKETS, np.int32)
    at[known] = np.arange(known.sum(), dtype=np.int32)
    tail = np.arange(known.sum(), len(used), dtype=np.int32)
    blocks = []
    for low in range(0, n, 500):
        index, value, sizes = [], [], []
        for buckets, logs, extra in rows[low : low + 500]:
            mine = known[buckets]
            v = logs[mine] * rarity[buckets[mine]]
            size = math.sqrt(float(v @ v))
            index += [at[buckets[mine]], tail]
            value += [(v * (LENGTH / size if size else 0.0)).astype(np.float32), extra]
            sizes.append(len(v) + len(tail))
        blocks.append((low, np.concatenate(index), np.concatenate(value), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(sizes)))
    k = len(used)
    parameters = np.concatenate([np.zeros(k), thresholds[:1], np.log(np.diff(thresholds))])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    share = np.bincount(grades, minlength=grade_count) / n
    weight = 1 / np.sqrt(share[grades])
    weight /= weight.mean()
    for step in range(1, steps + 1):
        cuts = parameters[k] + np.concatenate([[0], np.cumsum(np.exp(parameters[k + 1 :]))])
        score = np.concatenate([np.bincount(owner, value * parameters[index], minlength=count) for _, index, value, owner, count in blocks])
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
        lower, upper = below[np.arange(n), grades], below[np.arange(n), grades + 1]
        chance = np.maximum(upper - lower, 1e-12)
        low_slope, up_slope = weight * lower * (1 - lower) / chance / n, weight * upper * (1 - upper) / chance / n
        to_score = up_slope - low_slope  # derivatives of the negative log likelihood
        to_cuts = np.array([low_slope[grades == g + 1].sum() - up_slope[grades == g].sum() for g in range(grade_count - 1)])
        to_weights = ridge * parameters[:k]
        for low, index, value, owner, count in blocks:
            to_weights += np.bincount(index, value * to_score[low : low + count][owner], minlength=k)
        gradient = np.concatenate([to_weights, [to_cuts.sum()], np.cumsum(to_cuts[::-1])[::-1][1:] * np.exp(parameters[k + 1 :])])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        parameters -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    weights[used] = parameters[:k]
    return CumulativeLink(rarity.astype(np.float32), weights, parameters[k] + np.concatenate([[0], np.cumsum(np.exp(parameters[k + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CumulativeLink:
    """Fits on at most ``sample`` labelled documents, chosen by a hash of doc_id. Several labels of one id count as their lowest grade."""
    rated = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade()).alias("grade"))
    # At most `sample` rows, so the broadcast is bounded whatever the input.
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_in_worker("quality", Tokens)
        for batch in batches:
            found = [features(x, tokens) for x in texts(batch)]
            blobs = [pa.array([x[i].astype(t).tobytes() for x in found], pa.binary()) for i, t in ((0, "<i4"), (1, "<f2"), (2, "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), *blobs], names=["doc_id", "grade", "b", "v", "x"])

    if sample <= 0:
        return fit([], np.zeros(0, np.int64))
    # The rows that are collected are as many as the sample, not the input.
    got = map_arrow(rows, kernel, "doc_id long, grade int, b binary, v binary, x binary").toArrow().sort_by("doc_id")[:sample]
    parts = zip(*[got.column(c) for c in "bvx"], strict=True)
    found = [tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(row, ("<i4", "<f2", "<f4"), strict=True)) for row in parts]
    return fit(found, got.column("grade").to_numpy().astype(np.int64))


def grade_documents(docs: DataFrame, model: CumulativeLink, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, expected_grade, tail_probability, grade, kept), one for each row of ``docs``.

    ``tail_probability`` is that of the highest grade, ``grade`` the likeliest
    (the lower at a tie), ``kept`` whether the tail reaches the threshold.
    Null and empty texts have the one feature of having no words. Repeated
    rows are graded each, a null doc_id is kept, an empty table gives no rows.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_in_worker("quality", Tokens)
        for batch in batches:
            chances = model.tail(texts(batch), tokens)
            tail = chances[:, -1]
            columns = [pa.array(chances @ np.arange(chances.shape[1])), pa.array(tail), pa.array(chances.argmax(axis=1).astype(np.int32)), pa.array(tail >= threshold)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, SCHEMA)


def keep_documents(docs: DataFrame, model: CumulativeLink, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose probability of the highest grade reaches the threshold. One pass, no join."""
    at = docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_in_worker("quality", Tokens)
        for batch in batches:
            found = [x or "" for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.tail(found, tokens)[:, -1] >= threshold))

    return map_arrow(docs, kernel, docs.schema)
