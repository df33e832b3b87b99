"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1; unlabelled text is drawn from all training documents. With the class prior p of the web text
the classifier minimises  p E_pos[l(f)] + max(0, E_unl[l(-f)] - p E_pos[l(-f)])  with the logistic loss; where the second
term falls below zero, the step goes against it. The prior is estimated from the positives and the unlabelled rows alone, on halves scored by
a classifier of the other half: the share of unlabelled rows above a threshold, divided by that of the positives, is never far below
the prior and comes near it where nothing but positives is left. A lower bound of it is taken (two standard errors on both shares), as a prior that is
too large lets bad text pass, and more so on few rows.

Features of the whole text are square roots of shares: of pairs of byte classes (a-z, A-Z, digits, non-ASCII, space,
other white space, each punctuation mark) and of repeated words and lines; lang, source and doc_id are no features. The fit takes at most ``POSITIVES`` positive and ``UNLABELLED`` unlabelled rows (a documented bound, by a hash of
their key); only their feature vectors come to the driver. Scoring is one map without a shuffle.

Rows: null and empty texts have no pairs and get the score of empty features; a null ``doc_id`` is neither held out nor learned
from; repeated rows are scored each for itself, and of contradicting labels the larger counts; without any positive the score is
0.5; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import doc_texts, map_batches, text_filter, utf8

POSITIVES = 4096
UNLABELLED = 8192
FOLDS, HELD_FOLD = 5, 0
STEPS = 400
RATE = 0.05
DECAY = 3e-3
LEAST_PRIOR, MOST_PRIOR = 0.05, 0.95
THRESHOLD = 0.3
SLICE = 1 << 20
SCALE = 4.0

_FOUND_BY_RANGE = ((0x61, 0x7B), (0x41, 0x5B), (0x30, 0x3A), (0x80, 0x100), (0x20, 0x21), (0x00, 0x20))
_CLASS_OF = np.zeros(256, np.int64)
for _class, (_low, _high) in enumerate(_FOUND_BY_RANGE):
    _CLASS_OF[_low:_high] = _class
_MARKS = [b for b in range(0x21, 0x80) if not any(low <= b < high for low, high in _FOUND_BY_RANGE)]
_CLASS_OF[_MARKS] = len(_FOUND_BY_RANGE) + np.arange(len(_MARKS))
CLASSES = len(_FOUND_BY_RANGE) + len(_MARKS)
PAIRS = CLASSES * CLASSES
WIDTH = PAIRS + 4


def _repeats(parts: list[bytes]) -> tuple[float, float]:
    """Share of parts that equal the one before, and of the parts that are not the first of their kind among 100."""
    if len(parts) < 2:
        return 0.0, 0.0
    near = sum(map(eq, parts, parts[1:])) / (len(parts) - 1)
    again = 1 - sum(len(set(parts[i : i + 100])) for i in range(0, len(parts), 100)) / len(parts)
    return near, again


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of class pairs, of repeated words and of repeated lines."""
    counts = np.zeros(PAIRS)
    codes = np.frombuffer(text, np.uint8)
    for at in range(0, len(codes) - 1, SLICE):
        part = _CLASS_OF[codes[at : at + SLICE + 1]]
        counts += np.bincount(part[:-1] * CLASSES + part[1:], minlength=PAIRS)
    shares = counts / max(1.0, counts.sum())
    return np.sqrt(np.append(shares, [*_repeats(text.split()), *_repeats(text.splitlines())])).astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights + self.bias, -30, 30)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Adam on the non-negative risk of a linear classifier."""
    mean = unlabelled.mean(axis=0)
    p, u = SCALE * (positive - mean), SCALE * (unlabelled - mean)
    w = np.zeros(p.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)

    def sigmoid(f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))

    for step in range(1, steps + 1):
        v = w[:-1].astype(p.dtype)  # one type, or each product would copy the rows
        fp, fu = p @ v + w[-1], u @ v + w[-1]
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = -prior * sigmoid(fp) / len(p), sigmoid(fu) / len(u)  # slopes of the negative part
        if negative < 0:
            gp, gu = -gp, -gu
        else:
            gp = gp - prior * sigmoid(-fp) / len(p)
        slope = np.append(gp.astype(p.dtype) @ p + gu.astype(u.dtype) @ u + DECAY * w[:-1], gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = SCALE * w[:-1]
    return Model(weights.astype(np.float32), float(w[-1] - mean @ weights), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """A lower bound of the share of positives among the unlabelled rows."""
    scores = []
    for rows in (positive, unlabelled):
        scores.append(np.empty(len(rows)))
    half_p, half_u = np.arange(len(positive)) % 2 == 0, np.arange(len(unlabelled)) % 2 == 0
    for a, b in ((half_p, half_u), (~half_p, ~half_u)):
        if a.all() or b.all():  # too few rows for two halves
            return 0.5
        model = minimise(positive[~a], unlabelled[~b], 0.5)
        scores[0][a], scores[1][b] = model.scores(positive[a]), model.scores(unlabelled[b])
    found, every = np.sort(scores[0]), np.sort(scores[1])
    above_p = 1 - np.arange(len(found)) / len(found)
    above_u = 1 - np.searchsorted(every, found) / len(every)
    slack_p, slack_u = 1 / np.sqrt(len(found)), 1 / np.sqrt(len(every))
    at = ((above_u + slack_u) / above_p).argmin()
    return float(np.clip((above_u[at] - slack_u) / (above_p[at] + slack_p), LEAST_PRIOR, MOST_PRIOR))


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learns from the documents and labels outside the held-out fold."""
    rows = doc_texts(docs).filter(_fold(F.col("doc_id")) != HELD_FOLD)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("q"))
    marks = marks.filter((_fold(F.col("doc_id")) != HELD_FOLD) & F.col("q").isNotNull()).groupBy("doc_id").agg(F.max("q").alias("q"))
    order = (F.xxhash64("doc_id"), "doc_id")
    keys = rows.select("doc_id").distinct()
    trusted = keys.join(marks.filter("q = 1"), "doc_id").orderBy(*order).limit(positives)
    drawn = keys.orderBy(*order).limit(unlabelled)
    chosen = trusted.select(F.col("doc_id").alias("chosen"), F.lit(True).alias("positive")).unionByName(
        drawn.select(F.col("doc_id").alias("chosen"), F.lit(False).alias("positive"))
    )
    chosen = chosen.groupBy("chosen").agg(F.max("positive").alias("positive"), F.min("positive").alias("only_positive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(t).astype(np.float16).tobytes() for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("chosen"), batch.column("positive"), batch.column("only_positive"), pa.array(vectors, pa.binary())],
                ["doc_id", "positive", "only_positive", "vector"],
            )

    sample = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["chosen"]).select("text", "chosen", "positive", "only_positive")
    got = map_batches(sample, run, "doc_id bigint, positive boolean, only_positive boolean, vector binary")
    # Of rows that share a key the least vector is taken.
    got = got.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("only_positive").alias("only_positive"), F.min("vector").alias("vector"))
    got = got.orderBy("doc_id").toArrow()
    positive = got["positive"].to_numpy()
    if not positive.any():
        return Model(np.zeros(WIDTH, np.float32), 0.0, 0.5)
    background = ~got["only_positive"].to_numpy()
    vectors = np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in got["vector"]])
    # Most class pairs never occur: only those that do are fitted, the others keep the weight 0.
    used = vectors.any(axis=0)
    vectors = vectors[:, used].astype(np.float32)
    prior = class_prior(vectors[positive], vectors[background])
    fitted = minimise(vectors[positive], vectors[background], prior)
    weights = np.zeros(WIDTH, np.float32)
    weights[used] = fitted.weights
    return Model(weights, fitted.bias, prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Score and prediction of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [float(shared.value.scores(features(t))) for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    found = map_batches(doc_texts(docs), run, "doc_id bigint, score double")
    held = F.coalesce(_fold(F.col("doc_id")) == HELD_FOLD, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that reach the threshold; each row by its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accepts() -> Callable[[list[bytes]], list[bool]]:
        return lambda part: [bool(shared.value.scores(features(t)) >= threshold) for t in part]

    return text_filter(docs, accepts)
