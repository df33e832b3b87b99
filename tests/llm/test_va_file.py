"""Centroid clustering against plain rounds over all distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from qaloom.llm import queries, va_file


def plain(rows, k=16, rounds=3, width=64):
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == width and all(x is not None and math.isfinite(x) and abs(x) <= 2**21 for x in vector):
            kept.append((vec_id, np.array([math.floor(64 * x) for x in vector], np.int64)))
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)
    centroids = [np.array(v, np.int64) for _, v in order[:k]]
    if not centroids:
        return []

    def assign():
        found = []
        for _, v in kept:
            every = [int(((v - c) ** 2).sum()) for c in centroids]
            found.append((every.index(min(every)), min(every)))
        return found

    for _ in range(rounds):
        got = [c for c, _ in assign()]
        for c in range(len(centroids)):
            mine = [v for (_, v), g in zip(kept, got, strict=True) if g == c]
            if mine:
                centroids[c] = np.array([sum(map(int, x)) // len(mine) for x in zip(*mine, strict=True)], np.int64)
    got = assign()
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = [sum(d for c, d in got if c == k) for k in range(len(centroids))]
    return sorted(((i, c, d, sums[c], sum(sums), marks[c]) for (i, _), (c, d) in zip(kept, got, strict=True)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(queries.QUERIES["op13_centroids"](spark, f"/root/testdata/{sf}")) == plain(rows)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id bigint, embedding array<double>, row int, cells string")


def test_edge_rows(spark):
    rng = random.Random(1)
    some = [[rng.choice([-1.0, 0.0, 0.5, 0.011, 1.0]) for _ in range(64)] for _ in range(30)]
    rows = [(k, some[k % 30]) for k in range(90)] + [(None, some[0]), (5, some[7]), (5, some[7])]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 63 + [None]), (204, [math.nan] * 64), (205, [math.inf] * 64), (206, [1e30] * 64)]
    rows += [(207, [2.0**21] * 64), (208, [-(2.0**21)] * 64)]
    assert rows_of(va_file.digest(*va_file.cluster(vectors(spark, rows)))) == plain(rows)
    assert rows_of(va_file.digest(*va_file.cluster(vectors(spark, rows[:3])))) == plain(rows[:3])
    assert rows_of(va_file.digest(*va_file.cluster(vectors(spark, rows[93:100])))) == []
    assert va_file.digest(*va_file.cluster(vectors(spark, []))).count() == 0


def test_middle_rounds_fetch_the_undecided_and_the_moved_alone(spark, monkeypatch):
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 1, (16, 64))
    rows = [(k, (middles[k % 16] + rng.normal(0, 0.03, 64)).tolist()) for k in range(1600)]
    asked = []
    plain_fetch = va_file.Clustering._fetched
    monkeypatch.setattr(va_file.Clustering, "_fetched", lambda self, wanted: asked.append(wanted.count()) or plain_fetch(self, wanted))
    df = vectors(spark, rows)
    found, _ = va_file.cluster(df, rounds=6)
    assert asked[0] == asked[-1] == 1600 and asked[-2] < 400
    assert rows_of(found) == sorted(((i, c, d) for i, c, d, *_ in plain(rows, rounds=6)), key=str)


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(2)
    rows = rng.integers(-40, 40, (500, 7))
    marks = np.sort(rng.integers(-40, 40, (7, va_file.CELLS - 1)), axis=1)
    high = np.concatenate([marks, rows.max(axis=0)[:, None]], axis=1)
    low = np.concatenate([rows.min(axis=0)[:, None], marks + 1], axis=1)
    cells = va_file.Cells(np.minimum(low, high), high)
    centroids = rng.integers(-40, 40, (5, 7))
    distances = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
    open_ = va_file.candidates(cells.codes(rows), cells.tables(centroids))
    assert (open_ | (distances > distances.min(axis=1, keepdims=True))).all()
    best, exact = va_file.nearest(rows, open_, centroids)
    assert (best == distances.argmin(axis=1)).all() and (exact == distances.min(axis=1)).all()
