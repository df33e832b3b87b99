"""A perceptron with two hidden layers on vectors that count as often as they occur, with early stopping, fitted by L-BFGS.

A step is one pass over the rows; each task returns one gradient. What is broadcast and returned are the weights, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from qaloom.operators import linear

HIDDEN = (256, 64)
MOST = 500  # steps
PATIENCE = 10  # steps without a gain on the rows held out
GAIN = 1e-4
ALPHA = 1e-4
SEED = 42


def _layers(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Weights of each layer (inputs + bias, outputs) as views of one array."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append(flat[at : at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    return out


def _forward(layers: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """The inputs of each layer, and the scores."""
    seen = [x]
    for i, w in enumerate(layers):
        z = seen[-1] @ w[:-1] + w[-1]
        seen.append(np.maximum(z, 0.0) if i + 1 < len(layers) else z)
    return seen


def _vectors(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)


def _pass(rows: DataFrame, sizes: list[int], flat: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Summed loss and gradient over the ``copies``, and how many of the ``held`` ones are right."""
    shared = rows.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, total = _layers(shared.value, sizes), np.zeros(len(flat) + 2)
        slopes = _layers(total[2:], sizes)
        for batch in batches:
            if not len(batch):
                continue
            seen = _forward(layers, _vectors(batch, "embedding", sizes[0]))
            at, label = np.arange(len(batch)), batch.column("label").to_numpy()
            copies, held = (batch.column(c).to_numpy().astype(float) for c in ("copies", "held"))
            scores = seen[-1]
            total[1] += held[scores.argmax(axis=1) == label].sum()
            shares = np.exp(scores - scores.max(axis=1, keepdims=True))
            shares /= shares.sum(axis=1, keepdims=True)
            total[0] -= (copies * np.log(np.maximum(shares[at, label], 1e-300))).sum()
            shares[at, label] -= 1
            back = shares * copies[:, None]
            for i in reversed(range(len(layers))):
                slopes[i][:-1] += seen[i].T @ back
                slopes[i][-1] += back.sum(axis=0)
                back = (back @ layers[i][:-1].T) * (seen[i] > 0)
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["part"])

    parts = rows.mapInArrow(run, "part array<double>").toArrow()["part"]
    shared.destroy()
    total = sum((p.values.to_numpy() for p in parts), np.zeros(len(flat) + 2))
    return float(total[0]), total[2:], float(total[1])


def fit(rows: DataFrame, width: int, n_classes: int, hidden: tuple[int, ...] = HIDDEN, most: int = MOST) -> list[np.ndarray]:
    """Layers fitted on rows (embedding, label number, copies, held): a row is fitted ``copies`` times, and ``held`` others of it are kept for early stopping.

    The weights are those with most right answers on what is held out; without any, those of the last step.
    """
    rows = linear.checkpoint(rows.select("embedding", "label", "copies", "held"))
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    n, kept = rows.groupBy().sum("copies", "held").first()
    sizes = [width, *hidden, n_classes]
    start = np.zeros(sum((a + 1) * b for a, b in zip(sizes, sizes[1:], strict=False)))
    draw = np.random.default_rng(SEED)
    for w in _layers(start, sizes):
        bound = np.sqrt(6.0 / (w.shape[0] - 1 + w.shape[1]))
        w[:] = draw.uniform(-bound, bound, w.shape)
    run = linear._Descent(linear.Fit("perceptron", 1.0 / ALPHA), float(n or 0), start.shape, linear.TOLERANCE, most)
    run.trial, best, since = start, (-1.0, start), 0
    while run.open:
        loss, slope, right = _pass(rows, sizes, run.trial)
        tried = run.trial
        run.told(loss, slope)
        if run.x is not tried or not kept:
            best = best if kept else (-1.0, run.x)
            continue
        gained = right / kept > best[0] + GAIN
        best, since = ((right / kept, tried), 0) if gained else (best, since + 1)
        if since >= PATIENCE:
            break
    return _layers(best[1], sizes)


def predict(rows: DataFrame, layers: list[np.ndarray], labels: list[str], keep: list[str]) -> DataFrame:
    """(keep..., prediction) of rows with an ``embedding``."""
    shared = rows.sparkSession.sparkContext.broadcast(layers)
    slim = rows.select(*keep, "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(labels, pa.string())
        for batch in batches:
            if len(batch):
                found = _forward(shared.value, _vectors(batch, "embedding", len(shared.value[0]) - 1))[-1].argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), names.take(pa.array(found))], [*keep, "prediction"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keep).schema)
    return slim.mapInArrow(run, f"{fields}, prediction string")
