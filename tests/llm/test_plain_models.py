"""The quality and the language classifier against plain versions of their methods."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from qaloom.llm import language, quality, queries

SF = "/root/testdata/sf0.001"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)


def plain_risk(weights, bias, positive, unlabelled, prior):
    """The non-negative risk in loops, with the ridge of the operator."""

    def loss(f):
        return math.log1p(math.exp(-abs(f))) + max(0.0, -f)

    def mean(rows, sign):
        return sum(loss(sign * (float(r @ weights) + bias)) for r in rows) / len(rows)

    rest = mean(unlabelled, -1) - prior * mean(positive, -1)
    return prior * mean(positive, 1) + max(0.0, rest) + 0.5 * quality.DECAY * float(((weights / quality.SCALE) ** 2).sum())


def test_quality_equals_the_plain_fit(spark, documents):
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id] = max(r.quality, labels.get(r.doc_id, 0))
    taught = [r for r in documents if fold(r.doc_id, 5) != 0]
    rows = {r.doc_id: quality.features((r.text or "").encode()).astype(np.float16).astype(np.float32) for r in documents}
    positive = np.stack([rows[r.doc_id] for r in taught if labels.get(r.doc_id) == 1])
    unlabelled = np.stack([rows[r.doc_id] for r in taught])
    used = unlabelled.any(axis=0)
    prior = quality.class_prior(positive[:, used], unlabelled[:, used])
    model = quality.minimise(positive[:, used], unlabelled[:, used], prior)
    got = {r.doc_id: r for r in queries.QUERIES["op5_quality"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    for r in documents:
        plain = 1 / (1 + math.exp(-float(rows[r.doc_id][used] @ model.weights) - model.bias))
        assert got[r.doc_id].score == pytest.approx(plain, abs=0.02)
        assert got[r.doc_id].held_out == (fold(r.doc_id, 5) == 0) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
    # No direction lowers the risk by much: the fit is near a minimum of it.
    weights = model.weights.astype(float)
    best = plain_risk(weights, model.bias, positive[:, used], unlabelled[:, used], prior)
    assert best < 0.7 * plain_risk(0 * weights, 0.0, positive[:, used], unlabelled[:, used], prior)
    rng = np.random.default_rng(1)
    for _ in range(12):
        step = rng.normal(0, 0.3, len(weights))
        assert plain_risk(weights + step, model.bias, positive[:, used], unlabelled[:, used], prior) > best - 0.01


@pytest.mark.parametrize("share,n", [(0.3, 4000), (0.7, 4000), (0.9, 4000), (0.7, 200)])
def test_the_prior_is_a_lower_bound_that_comes_near(share, n):
    rng = np.random.default_rng(int(10 * share))

    def draw(size, good):
        return (rng.normal(0, 1, (size, 4)) + 3.0 * good[:, None] * np.array([1, 0, 0, 0])).astype(np.float32)

    found = quality.class_prior(draw(n, np.ones(n)), draw(n, (rng.random(n) < share).astype(float)))
    assert share - (0.12 if n > 1000 else 0.35) <= found <= share + 0.02


def grams(text):
    t = text.lower()
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_language_equals_plain_kernel_ridge(spark, documents):
    """N-gram sets instead of hashed bits, and the normal equations in full."""
    order = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null").orderBy(F.xxhash64("doc_id"), "doc_id")
    taught = [r for r in order.collect() if fold(r.doc_id, 4) != 2 and r.text and any(c.isalpha() for c in r.text)]
    names = sorted({r.lang for r in taught})
    each = language.LANDMARKS // len(names)
    marks = [grams(r.text) for name in names for r in [x for x in taught if x.lang == name][:each]]

    def kernel(texts):
        sets = [grams(t) for t in texts]
        return np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in marks] for a in sets])

    among = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(among)
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))
    x = kernel([r.text for r in taught]) @ root
    number = np.array([names.index(r.lang) for r in taught])
    weight = (1 / np.bincount(number))[number] / len(names)
    gram = sum(w * np.outer(row, row) for w, row in zip(weight, x, strict=True)) + language.RIDGE * np.eye(len(marks))
    right = sum(w * np.outer(row, np.eye(len(names))[k]) for w, row, k in zip(weight, x, number, strict=True))
    solved = root @ np.linalg.solve(gram, right)
    asked = [r for r in documents if r.text and any(c.isalpha() for c in r.text)]
    scores = kernel([r.text for r in asked]) @ solved
    got = {r.doc_id: r for r in queries.QUERIES["op8_language"](spark, SF).collect()}
    same = [got[r.doc_id].lang_pred == names[s.argmax()] for r, s in zip(asked, scores, strict=True)]
    near = [abs(got[r.doc_id].score - min(1.0, max(0.0, s.max()))) for r, s in zip(asked, scores, strict=True)]
    assert np.mean(same) >= 0.99 and np.median(near) < 0.05
