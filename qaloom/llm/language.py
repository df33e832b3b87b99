"""Language identification by a string kernel with Nyström landmarks and kernel ridge regression.

The kernel counts the character n-grams, n = 1 to 3, that two texts share (presence, not frequency), divided by the
root of their numbers of n-grams. N-grams are those of the whole lower-cased text; they are hashed into ``BUCKETS`` presence bits.
Nyström landmarks are training texts, evenly over the languages; one ridge regression per language against the rest
runs on the landmark features. Scoring is two products per batch of texts: presence bits by landmark bits, and the
normalised kernel values by one small matrix.

The fit takes at most ``ROWS_PER_LANGUAGE`` training keys of each language (a documented bound, by a hash of the key), and
one row of each, however often a key repeats; their presence bits, not their texts, come to the driver. Scoring is one map without a shuffle.

Rows: a text that is null or has no letter is ``und`` with score 0; without any training row all are; a null ``doc_id`` is
neither held out nor learned from; repeated rows are scored each for itself; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.llm.common import doc_texts, map_batches, text_filter, texts

BITS = 15
BUCKETS = 1 << BITS
ORDERS = 3
LANDMARKS = 64
ROWS_PER_LANGUAGE = 768
RIDGE = 1e-3
FOLDS, HELD_FOLD = 4, 2
UNKNOWN = "und"
BATCH_TEXTS = 128
BATCH_CHARS = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")
_FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def presence(batch: list[str]) -> np.ndarray:
    """Presence of each n-gram bucket, a row per text."""
    flat = np.zeros(len(batch) * BUCKETS, bool)
    for k, text in enumerate(batch):
        row = flat[k * BUCKETS : (k + 1) * BUCKETS]
        for at in range(0, max(1, len(text)), BATCH_CHARS):  # very long texts in slices that overlap
            part = text[max(0, at - ORDERS + 1) : at + BATCH_CHARS].lower()
            codes = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
            grams = np.zeros(len(codes), np.uint32)
            for n in range(ORDERS):
                grams = (grams[: len(grams) - (n > 0)] + codes[n:] + np.uint32(n + 1)) * _FACTORS[n]
                if not len(grams):
                    break
                row[(grams ^ (grams >> np.uint32(15))) * np.uint32(668265263) >> np.uint32(32 - BITS)] = True
    return flat.reshape(len(batch), BUCKETS)


@dataclass(frozen=True)
class Model:
    """Landmark bits, their norms, and the matrix from kernel values to one score per language."""

    languages: tuple[str, ...]
    bits: np.ndarray  # packed, a row per landmark
    weights: np.ndarray

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        landmarks = np.unpackbits(self.bits, axis=1).astype(np.float32)
        norms = np.sqrt(landmarks.sum(axis=1))
        columns = np.ascontiguousarray(landmarks.T)

        def score(batch: list[str]) -> np.ndarray:
            return kernel(presence(batch).astype(np.float32), columns, norms) @ self.weights

        return score


def kernel(rows: np.ndarray, columns: np.ndarray, norms: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    return (rows @ columns) / own / norms


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame, landmarks: int = LANDMARKS, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from rows with a language outside the held-out fold."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").alias("label")
    ).filter(F.col("label").isNotNull() & (_fold(F.col("doc_id")) != HELD_FOLD))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        rows.select("doc_id", "label")
        .distinct()
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= rows_per_language)
        .select(F.col("doc_id").alias("chosen"), F.col("label").alias("of"), "place")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (label, place, np.packbits(presence([text])).tobytes())
                for label, place, text in zip(*(batch.column(c).to_pylist() for c in ("label", "place", "text")), strict=True)
                if text and _LETTER.search(text)
            ]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["label", "place", "bits"])

    sample = rows.join(F.broadcast(chosen), (rows["doc_id"] == chosen["chosen"]) & (rows["label"] == chosen["of"]))
    got = map_batches(sample.select("label", "place", "text"), run, "label string, place bigint, bits binary")
    # Of rows that share key and label the least vector is taken, so a place has one row.
    got = got.groupBy("label", "place").agg(F.min("bits").alias("bits")).orderBy("place", "label").collect()
    if not got:
        return Model((), np.zeros((0, BUCKETS // 8), np.uint8), np.zeros((0, 0), np.float32))
    languages = tuple(sorted({r["label"] for r in got}))
    bits = np.stack([np.frombuffer(r["bits"], np.uint8) for r in got])
    labels = np.array([languages.index(r["label"]) for r in got])
    each = max(1, landmarks // len(languages))
    marks = np.concatenate([np.flatnonzero(labels == k)[:each] for k in range(len(languages))])
    columns = np.unpackbits(bits[marks], axis=1).astype(np.float32)
    norms = np.sqrt(columns.sum(axis=1))
    columns = np.ascontiguousarray(columns.T)
    kernels = [
        kernel(np.unpackbits(bits[i : i + BATCH_TEXTS], axis=1).astype(np.float32), columns, norms)
        for i in range(0, len(bits), BATCH_TEXTS)
    ]
    k = np.concatenate(kernels).astype(float)
    values, vectors = np.linalg.eigh(k[marks])
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))
    features = k @ root
    target = np.eye(len(languages))[labels]
    # Languages weigh the same, however many of their rows were taken.
    weight = (1 / np.bincount(labels))[labels][:, None] / len(languages)
    gram = features.T @ (weight * features) + RIDGE * np.eye(len(marks))
    return Model(languages, bits[marks], (root @ np.linalg.solve(gram, features.T @ (weight * target))).astype(np.float32))


def predictor(model: Model) -> Callable[[list[str | None]], tuple[list[str], list[float]]]:
    score = model.scorer() if model.languages else None

    def predict(batch: list[str | None]) -> tuple[list[str], list[float]]:
        names, values = [UNKNOWN] * len(batch), [0.0] * len(batch)
        at = [k for k, text in enumerate(batch) if score and text and _LETTER.search(text)]
        for i in range(0, len(at), BATCH_TEXTS):
            part = at[i : i + BATCH_TEXTS]
            found = score([batch[k] for k in part])
            for k, best, value in zip(part, found.argmax(axis=1), found.max(axis=1), strict=True):
                names[k], values[k] = model.languages[best], float(min(1.0, max(0.0, value)))
        return names, values

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(shared.value)
        for batch in batches:
            names, values = predict(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(values, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    found = map_batches(doc_texts(docs), run, "doc_id bigint, lang_pred string, score double")
    held = F.coalesce(_fold(F.col("doc_id")) == HELD_FOLD, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents, with all their columns, whose language is known with at least the score ``least``; each row by its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def accepts() -> Callable[[list[bytes]], list[bool]]:
        predict = predictor(shared.value)

        def known(part: list[bytes]) -> list[bool]:
            names, values = predict([t.decode("utf-8", "replace") for t in part])
            return [n != UNKNOWN and v >= least for n, v in zip(names, values, strict=True)]

        return known

    return text_filter(docs, accepts)
