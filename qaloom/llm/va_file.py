"""Centroid clustering through a VA-file: few-bit approximations decide, full vectors are fetched only where they must.

Components become integers. Each dimension is cut into 2^``BITS`` cells at quantiles of all vectors, and a vector's approximation is
its cell numbers, half a byte a dimension. Two tables stay on Spark's side: the approximations with the current cluster, and the full vectors,
bucketed by row. A round scans the approximations alone. For each pair of dimensions a lookup table holds what a pair of cells
adds to the least and to the largest squared distance from every centroid; the sums are an interval per centroid. A centroid
whose least distance exceeds another's largest is out. If one is left, the vector is decided without being read. The others, and those that change
their cluster, are joined to the full vectors, whose side of the join is not shuffled; the exact distance from the centroids left
settles them, ties to the smaller number. Sums of the clusters are kept from round to round: only vectors that move are added and
taken off. So a middle round reads the undecided and the moved; the first reads all for the sums, the last for the distances.

All arithmetic is on integers: sums are decimals, new centroids exact floors. What reaches the driver is bounded by the
number of centroids and dimensions, not by rows.

Rows: vectors that are null, have another number of components, or hold null or non-finite ones take no part, neither do those with a component
beyond ``LARGEST`` in size, whose squared distances need not fit a long; a row without ``vec_id`` is clustered but never a start;
repeated rows count each for itself, also as starts; with fewer vectors than centroids all are starts; an empty table gives no rows; sums of distances
that exceed a long are null; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import map_batches, new_folder, stored

BITS = 4
CELLS = 1 << BITS
LARGEST = 1 << 27
BUCKET_ROWS = 1 << 18
MOST_BUCKETS = 50_000
PAIRS = 1 << 14  # exact distances computed at once
ACCURACY = 200  # of the quantiles the cells are cut at; any cuts give the same clusters

STATE = "row bigint, cells binary, old int, cluster int, candidates binary"
SETTLED = "row bigint, cells binary, cluster int, change array<bigint>, n bigint"


def whole(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v``, the integers floor(scale * x), of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST / scale))
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("embedding"))
    kept = kept.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("int")).alias("v"))


@dataclass(frozen=True)
class Cells:
    """The least and largest integer of each cell, a row per dimension."""

    low: np.ndarray
    high: np.ndarray

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """Cell numbers of the vectors, two to a byte."""
        found = np.empty(rows.shape, np.uint8)
        for d in range(rows.shape[1]):
            found[:, d] = np.searchsorted(self.high[d, :-1], rows[:, d])
        if rows.shape[1] % 2:
            found = np.pad(found, ((0, 0), (0, 1)))
        return found[:, ::2] | found[:, 1::2] << BITS

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """By byte and code: what the two cells add to the least and, behind them, the largest distances from all centroids."""
        c = centroids.T[:, None, :]  # dimension, cell, centroid
        below, above = self.low[:, :, None] - c, self.high[:, :, None] - c
        far = np.maximum(below**2, above**2)
        near = np.where((below > 0) | (above < 0), np.minimum(below**2, above**2), 0)
        both = np.concatenate([near, far], axis=2)
        if len(both) % 2:
            both = np.concatenate([both, np.zeros_like(both[:1])])
        code = np.arange(CELLS * CELLS)
        return both[::2][:, code % CELLS] + both[1::2][:, code // CELLS]


def cut(rows: DataFrame, dimensions: int) -> tuple[int, Cells | None]:
    """The number of vectors, and cells cut at quantiles of every dimension."""
    shares = [k / CELLS for k in range(1, CELLS)]
    v = [F.get("v", F.lit(d)) for d in range(dimensions)]
    found = rows.agg(
        F.count("*").alias("n"),
        F.array(*map(F.min, v)).alias("least"),
        F.array(*map(F.max, v)).alias("most"),
        F.array(*(F.percentile_approx(x, shares, ACCURACY) for x in v)).alias("marks"),
    ).first()
    if not found["n"]:
        return 0, None
    least, most, marks = (np.array(found[c], np.int64) for c in ("least", "most", "marks"))
    high = np.concatenate([marks, most[:, None]], axis=1)
    low = np.concatenate([least[:, None], marks + 1], axis=1)
    return found["n"], Cells(np.minimum(low, high), high)  # a cell that holds no integer is never met


def starts(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed`` and id, in that order."""
    hashed = rows.filter(F.col("vec_id").isNotNull()).select(
        F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("hash"), "v"
    )
    return np.array([r["v"] for r in hashed.orderBy("hash", "v").limit(k).collect()], np.int64)


def candidates(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Which centroids may be the nearest of each approximation; ties and overlapping intervals stay."""
    bounds = np.zeros((len(codes), tables.shape[2]), np.int64)
    for b, table in enumerate(tables):
        bounds += table[codes[:, b]]
    k = tables.shape[2] // 2
    return bounds[:, :k] <= bounds[:, k:].min(axis=1, keepdims=True)


def nearest(rows: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid among the open ones."""
    distance = np.full(open_.shape, np.iinfo(np.int64).max)
    i, c = np.nonzero(open_)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], c[at : at + PAIRS]
        distance[a, b] = ((rows[a] - centroids[b]) ** 2).sum(axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(best)), best]


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """The rows of a column of binaries or lists of one length."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _rows_of(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1]
    data = np.ascontiguousarray(matrix).tobytes()
    return pa.array([data[k : k + width] for k in range(0, len(data), width)], pa.binary())


class Clustering:
    """The two tables of a run, and its centroids and sums."""

    def __init__(self, rows: DataFrame, n: int, cells: Cells, centroids: np.ndarray):
        self.spark = rows.sparkSession
        self.cells = cells
        self.centroids = centroids
        self.k, self.dimensions = centroids.shape
        self.sums = [[0] * self.dimensions for _ in range(self.k)]
        self.counts = [0] * self.k
        folder = new_folder(self.spark, "op13-vectors")
        self.table = "qaloom_" + folder.rsplit("/", 1)[1].replace("-", "_")
        buckets = min(MOST_BUCKETS, -(-n // BUCKET_ROWS))
        numbered = rows.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row")
        numbered.write.format("parquet").option("path", folder).bucketBy(buckets, "row").sortBy("row").saveAsTable(self.table)
        self.full = self.spark.table(self.table)
        self.state = stored(self._approximated(), "op13-cells")

    def _approximated(self) -> DataFrame:
        cells = self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                codes = cells.codes(_matrix(batch.column("v"), np.int64))
                none = pa.array(np.full(len(batch), -1, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("row"), _rows_of(codes), none], ["row", "cells", "cluster"])

        return map_batches(self.full.select("row", "v"), run, "row bigint, cells binary, cluster int")

    def _scanned(self) -> DataFrame:
        """The state by approximations: ``cluster`` is -1 where several ``candidates`` are left."""
        tables = self.spark.sparkContext.broadcast(self.cells.tables(self.centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                open_ = candidates(_matrix(batch.column("cells"), np.uint8), tables.value)
                cluster = np.where(open_.sum(axis=1) == 1, open_.argmax(axis=1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("row", "cells", "cluster")), pa.array(cluster), _rows_of(np.packbits(open_, axis=1))],
                    ["row", "cells", "old", "cluster", "candidates"],
                )

        return stored(map_batches(self.state.select("row", "cells", "cluster"), run, STATE), "op13-scanned")

    def _fetched(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.full, "row")

    def assign(self) -> None:
        """One round: clusters of all vectors, then the centroids of the next round."""
        scanned = self._scanned()
        open_, moved = F.col("cluster") < 0, F.col("cluster") != F.col("old")
        centroids, k = self.centroids, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                rows = _matrix(batch.column("v"), np.int64)
                left = np.unpackbits(_matrix(batch.column("candidates"), np.uint8), axis=1)[:, :k].astype(bool)
                cluster, _ = nearest(rows, left, centroids)
                old = batch.column("old").to_numpy()
                gone = np.flatnonzero((cluster != old) & (old >= 0))
                come = np.flatnonzero(cluster != old)
                change, n = np.zeros((k, rows.shape[1]), np.int64), np.zeros(k, np.int64)
                np.add.at(change, cluster[come], rows[come])
                np.subtract.at(change, old[gone], rows[gone])
                n += np.bincount(cluster[come], minlength=k) - np.bincount(old[gone], minlength=k)
                names = ["row", "cells", "cluster", "change", "n"]
                nothing = [pa.nulls(len(batch), pa.list_(pa.int64())), pa.nulls(len(batch), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("cells"), pa.array(cluster.astype(np.int32)), *nothing], names
                )
                some = np.flatnonzero(change.any(axis=1) | (n != 0))
                lists = pa.array(change[some].tolist(), pa.list_(pa.int64()))
                of = [pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*of, lists, pa.array(n[some])], names)

        settled = stored(map_batches(self._fetched(scanned.filter(open_ | moved)), run, SETTLED), "op13-settled")
        kept = scanned.filter(~open_ & ~moved).select("row", "cells", "cluster")
        self.state = kept.unionByName(settled.filter("row IS NOT NULL").select("row", "cells", "cluster"))
        changes = settled.filter("row IS NULL")
        wide = F.col("n").cast("decimal(38,0)")
        for r in changes.groupBy("cluster").agg(F.sum(wide).alias("n")).collect():
            self.counts[r["cluster"]] += int(r["n"])
        parts = changes.select("cluster", F.posexplode("change").alias("d", "x")).groupBy("cluster", "d")
        for r in parts.agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            self.sums[r["cluster"]][r["d"]] += int(r["x"])
        means = [
            [x // n for x in sums] if n else old.tolist()
            for sums, n, old in zip(self.sums, self.counts, self.centroids, strict=True)
        ]
        self.centroids = np.array(means, np.int64)

    def result(self) -> DataFrame:
        """``vec_id``, ``cluster`` and ``distance`` of every vector under the current centroids."""
        centroids, k = self.centroids, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                left = np.unpackbits(_matrix(batch.column("candidates"), np.uint8), axis=1)[:, :k].astype(bool)
                cluster, distance = nearest(_matrix(batch.column("v"), np.int64), left, centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
                )

        exact = map_batches(self._fetched(self._scanned()), run, "vec_id bigint, cluster int, distance bigint")
        return stored(exact, "op13-clusters")

    def close(self) -> None:
        """Forgets the table of full vectors; its files stay in the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: str = "1:"
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``cluster`` and ``distance`` of every vector that takes part, and the final centroids."""
    rows = whole(vectors, dimensions, scale)
    n, cells = cut(rows, dimensions)
    first = starts(rows, k, seed) if n else np.zeros((0, dimensions), np.int64)
    if not len(first):
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), first
    run = Clustering(rows, n, cells, first)
    for _ in range(rounds):
        run.assign()
    found = run.result()
    run.close()
    return found, run.centroids


def _long(total: Column) -> Column:
    return total.try_cast("bigint")


def digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The clusters with their inertia, that of all, and a checksum of each centroid."""
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    sums = {r["cluster"]: r["total"] for r in sums.collect()}  # a row per centroid
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, sums.get(c), m) for c, m in enumerate(marks)]
    facts = found.sparkSession.createDataFrame(facts, "cluster int, total decimal(38,0), centroid_sha256 string")
    whole_sum = F.lit(sum(sums.values())).cast("decimal(38,0)")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", _long(F.col("total")).alias("cluster_inertia"), _long(whole_sum).alias("inertia"), "centroid_sha256"
    )
