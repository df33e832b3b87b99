"""Exact cosine joins within blocks, and the de-duplication rules built on them.

Nothing here forms all pairs of a block. Identical vectors are collapsed first (a counted
aggregate), so a group of copies is one row. The rest is cut into cells around pivot vectors: two
unit vectors with cosine above t are closer than sqrt(2 - 2t), so a vector is repeated only in the
cells whose bisecting plane is that close, and no qualifying pair is lost; where that prunes nothing, a
block is one cell. Cells are cut into chunks, and each pair of chunks is one bounded tile that compares by
matrix product, a part at a time, and emits only what qualifies.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaloom.functions import draws
from qaloom.operators.ranking import join_on
from qaloom.session import checkpoint, lookup, shared_folder

CHUNK_ROWS = 8192
CELL_ROWS = 8192
PLACED_ROWS = 1024  # given their cells at once
MATRIX = 1 << 21  # comparisons held at once
SENT = 512  # comparisons that take as long as sending a row to one more task
FIRST_ROWS = 1000  # of a block that the greedy rule settles at once; Spark cuts such a rank before its shuffle
EDGES_PER_ROW = 64  # pairs that are listed for a vector on average, at most
LOCAL_EDGES = 1_000_000  # of a block, settled by one task
TILE = ("cell", "a", "b")
_SLACK = 1e-6


def distinct_vectors(df: DataFrame, key: str, vector: str, by: list[str]) -> DataFrame:
    """One row per distinct vector and block: (by, id = smallest key, vec = unit vector, copies)."""
    collapsed = df.groupBy(*by, vector).agg(
        F.min(key).alias("id"), F.count(F.lit(1)).alias("copies")
    )
    length = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    known = F.when(F.col("__len") > 0, F.col("__len")).otherwise(1.0)
    scaled = F.transform(vector, lambda x: x.cast("double") / known)
    return collapsed.withColumn("__len", length).select(*by, "id", scaled.alias("vec"), "copies")


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """A bounded set of pivot vectors, chosen by hash draw so that retries choose the same."""
    picked = rows.orderBy(draws.draw("pivot", F.col("id")), "id").limit(n).select("vec")
    return np.unique(np.array([r[0] for r in picked.collect()]), axis=0)


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of vectors as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _place(pivots: np.ndarray, reach: float):
    """Task function: adds the cells of each row, its own first, then the lower ones its partners may call home."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Distances between pivots, never too small: rounding may only add candidates.
        squared = (pivots**2).sum(axis=1)
        gaps = squared[:, None] + squared[None, :] - 2.0 * (pivots @ pivots.T)
        gaps = np.sqrt(np.maximum(gaps, 0.0)) + _SLACK
        for whole in batches:
            for at in range(0, whole.num_rows, PLACED_ROWS):
                batch = whole.slice(at, PLACED_ROWS)
                squares = 1.0 + squared[None, :] - 2.0 * (_vectors(batch.column("vec")) @ pivots.T)
                home = squares.argmin(axis=1)
                excess = squares - squares[np.arange(len(home)), home][:, None]
                near = excess <= 2.0 * gaps[home] * (reach + _SLACK)
                near &= np.arange(len(pivots))[None, :] < home[:, None]
                cells = [np.append(h, np.flatnonzero(row)) for h, row in zip(home, near, strict=True)]
                cells = pa.array(cells, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return place


def _placed(rows: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(_place(pivots, math.sqrt(max(0.0, 2.0 - 2.0 * threshold))), schema)


def _work(homes: Column, visitors: Column, chunk_rows: int) -> Column:
    """Comparisons of a cell, and the rows sent to its tiles at the worth of ``SENT`` comparisons each."""
    chunks, more = F.ceil(homes / chunk_rows), F.ceil(visitors / chunk_rows)
    return homes * (homes / 2 + visitors) + SENT * (homes * (chunks + more) + visitors * chunks)


def _cells(rows: DataFrame, by: list[str], threshold: float, total: int, cell_rows: int, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with cell and home, and the numbers of rows at home and visiting by cell.

    Where vectors have no structure, nearly all rows visit nearly all cells, which prunes nothing: a block is one cell if
    that is less work, by the counted sizes of all cells.
    """
    blocks = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("homes"), F.lit(0).cast("bigint").alias("visitors"))
    blocks = checkpoint(blocks.withColumn("cell", F.lit(0).cast("bigint")))
    # Cells of fixed size while pivots are few; beyond, pivots and cells both grow with the root of the rows.
    n_pivots = min(math.ceil(total / cell_rows), math.ceil(math.sqrt(total) / 2))
    pivots = _pivots(rows, n_pivots) if n_pivots > 1 else np.empty((0, 0))
    if len(pivots) > 1:
        counted = _placed(rows.select(*by, "vec"), pivots, threshold).select(*by, F.posexplode("cells").alias("__at", "cell"))
        at = F.col("__at")
        sizes = counted.groupBy(*by, "cell").agg(F.count_if(at == 0).alias("homes"), F.count_if(at > 0).alias("visitors"))
        sizes = checkpoint(sizes)
        cost = F.sum(_work(F.col("homes"), F.col("visitors"), chunk_rows))
        if sizes.agg(cost).first()[0] < blocks.agg(cost).first()[0]:
            placed = _placed(rows, pivots, threshold).select(*rows.columns, F.posexplode("cells").alias("__at", "cell"))
            return placed.withColumn("home", F.col("__at") == 0).drop("__at"), sizes
    return rows.withColumns({"cell": F.lit(0).cast("bigint"), "home": F.lit(True)}), blocks


def _tiled(rows: DataFrame, by: list[str], threshold: float, cell_rows: int, chunk_rows: int) -> DataFrame:
    """Rows repeated once per pair of chunks (tile) they take part in: adds cell, a, b, chunk.

    Rows at home are cut into the first chunks of their cell, visitors into the later ones, and no two chunks of
    visitors meet.
    """
    total = rows.count()
    if total <= chunk_rows:
        one = F.lit(0).cast("int")
        return rows.withColumns({"cell": F.lit(0).cast("bigint"), "a": one, "b": one, "chunk": one})
    rows, sizes = _cells(rows, by, threshold, total, cell_rows, chunk_rows)
    pieces = [F.ceil(F.col(c) / chunk_rows).cast("int").alias(f"__{c}") for c in ("homes", "visitors")]
    rows = join_on(rows, lookup(sizes.where("homes > 0").select(*by, "cell", *pieces)), [*by, "cell"])
    drawn, homes, visitors = draws.draw("chunk", F.col("id")), F.col("__homes"), F.col("__visitors")
    chunk = F.when(F.col("home"), drawn % homes).otherwise(homes + drawn % F.greatest(visitors, F.lit(1))).cast("int")
    partners = F.sequence(F.lit(0), F.when(F.col("home"), homes + visitors).otherwise(homes) - 1)
    return (
        rows.withColumn("chunk", chunk)
        .select("*", F.explode(partners).alias("__other"))
        .withColumns({"a": F.least("chunk", "__other"), "b": F.greatest("chunk", "__other")})
        .drop("__homes", "__visitors", "__other", "home")
    )


def _matches(group: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs of one tile that qualify, with their cosines, of at most ``MATRIX`` compared at once."""
    a, b, chunk = group["a"][0].as_py(), group["b"][0].as_py(), group["chunk"].to_numpy()
    vectors = _vectors(group["vec"].chunk(0))
    left = np.flatnonzero(chunk == a)
    right = left if a == b else np.flatnonzero(chunk == b)
    if not len(left) or not len(right):
        return
    across = vectors[right].T
    step = max(1, MATRIX // len(right))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        cosine = vectors[part] @ across
        hit = cosine > threshold
        if a == b:
            hit &= np.arange(len(right))[None, :] > np.arange(at, at + len(part))[:, None]
        i, j = np.nonzero(hit)
        yield part[i], right[j], cosine[i, j]


def _in_tiles(tiles: DataFrame, keys: list[str], function: Callable[[pa.Table], Iterable[dict]], by: list[str], rest: str) -> DataFrame:
    """Runs ``function`` on each group of ``keys``; what it yields are columns, with the row (``at``) each has its block from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).combine_chunks()
        for out in function(group):
            at = pa.array(out.pop("at"), pa.int64())
            columns = [group[b].chunk(0).take(at) for b in by]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, out.values())], [*by, *out])

    return tiles.groupBy(*keys).applyInArrow(run, _schema_of(tiles, by, rest))


def _schema_of(df: DataFrame, by: list[str], rest: str) -> T.StructType:
    keys = [df.schema[b] for b in by]
    return T.StructType(keys + T.StructType.fromDDL(rest).fields)


def similar_pairs(
    df: DataFrame,
    key: str,
    vector: str,
    by: list[str],
    threshold: float,
    cell_rows: int = CELL_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Pairs of distinct vectors with cosine above the threshold, within each block.

    One row per pair of *distinct* vectors, named by their smallest keys, with the number of row
    pairs it stands for; a vector with copies adds one row with id_a = id_b. Listing the copies
    themselves would be quadratic in the largest group and adds no information.
    """
    rows = checkpoint(distinct_vectors(df, key, vector, by))

    def compare(group: pa.Table) -> Iterator[dict]:
        ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
        for i, j, cosine in _matches(group, threshold):
            x, y = ids[i], ids[j]
            yield {"at": i, "id_a": np.minimum(x, y), "id_b": np.maximum(x, y), "cosine": cosine, "n_pairs": copies[i] * copies[j]}

    tiles = _tiled(rows, by, threshold, cell_rows, chunk_rows)
    found = _in_tiles(tiles, [*by, *TILE], compare, by, "id_a BIGINT, id_b BIGINT, cosine DOUBLE, n_pairs BIGINT")
    n = F.col("copies")
    copies = rows.where(n > 1).select(
        *by,
        F.col("id").alias("id_a"),
        F.col("id").alias("id_b"),
        F.lit(1.0).alias("cosine"),
        F.expr("copies * (copies - 1) div 2").alias("n_pairs"),
    )
    return found.unionByName(copies)


def near_duplicate_counts(
    df: DataFrame,
    key: str,
    vector: str,
    by: list[str],
    thresholds: list[float],
    cell_rows: int = CELL_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per block the row count, pair count, largest cosine and pairs above each threshold.

    Counting happens inside the tiles, so no pair is listed. A block whose largest cosine is
    below every threshold is searched again with a lower one until its largest is known.
    """
    rows = checkpoint(distinct_vectors(df, key, vector, by))
    levels = sorted(thresholds)
    names = {t: f"above_{t:g}".replace(".", "_") for t in thresholds}

    def counter(floor: float):
        def count(group: pa.Table) -> Iterator[dict]:
            copies, largest, above = group["copies"].to_numpy(), None, dict.fromkeys(levels, 0)
            for i, j, cosine in _matches(group, floor):
                if len(cosine):
                    largest = max(cosine.max(), -math.inf if largest is None else largest)
                weight = copies[i] * copies[j]
                above = {t: n + int(weight[cosine > t].sum()) for t, n in above.items()}
            out = {"at": [0], "max_cosine": pa.array([largest], pa.float64())}
            yield out | {names[t]: pa.array([n], pa.int64()) for t, n in above.items()}

        return count

    fields = "max_cosine DOUBLE, " + ", ".join(f"{names[t]} BIGINT" for t in levels)
    n = F.col("copies")
    own_pairs = F.sum(F.expr("copies * (copies - 1) div 2"))
    own = rows.groupBy(*by).agg(
        F.sum(n).alias("n_rows"),
        F.count(F.lit(1)).alias("__distinct"),
        own_pairs.alias("__own"),
        F.max(F.when(n > 1, F.lit(1.0))).alias("__copy"),
    )
    own = checkpoint(own)
    out, todo = None, rows
    # Lower by small steps: a block's largest cosine is usually near, where most is still pruned.
    for floor in [levels[0] - step for step in (0.0, 0.05, 0.15, 0.35)] + [-1.1]:
        tiles = _tiled(todo, by, floor, cell_rows, chunk_rows)
        counted = _in_tiles(tiles, [*by, *TILE], counter(floor), by, fields)
        counted = counted.groupBy(*by).agg(
            F.max("max_cosine").alias("max_cosine"), *[F.sum(names[t]).alias(names[t]) for t in levels]
        )
        counted = checkpoint(counted)
        known = counted.where(F.col("max_cosine").isNotNull())
        out = known if out is None else out.unionByName(known)
        # Blocks with two distinct vectors or more always have a largest cosine to find.
        open_blocks = checkpoint(
            counted.where(F.col("max_cosine").isNull())
            .select(*by)
            .join(own.where(F.col("__distinct") > 1).select(*by), by, "left_semi")
        )
        if open_blocks.isEmpty():
            break
        todo = todo.join(open_blocks, by, "left_semi")
    return join_on(own, out, by, "left").select(
        *by,
        "n_rows",
        F.expr("n_rows * (n_rows - 1) div 2").alias("n_pairs"),
        F.greatest(F.col("max_cosine"), F.col("__copy")).alias("max_cosine"),
        *[
            (F.coalesce(names[t], F.lit(0)) + F.when(F.lit(t < 1.0), F.col("__own")).otherwise(0)).alias(
                names[t]
            )
            for t in levels
        ],
    )


def _flagged(rows: DataFrame, by: list[str], threshold: float, cell_rows: int, chunk_rows: int, rule: str) -> DataFrame:
    """Ids with qualifying partners, and how many (``n``): earlier ones ("earlier"), or kept ones ("kept")."""

    def flag(group: pa.Table) -> Iterator[dict]:
        ids, n = group["id"].to_numpy(), np.zeros(len(group), np.int64)
        kept = group["kept"].chunk(0).to_numpy(zero_copy_only=False) if rule == "kept" else None
        for i, j, _ in _matches(group, threshold):
            hit = np.where(ids[i] > ids[j], i, j) if kept is None else np.concatenate([j[kept[i] & ~kept[j]], i[kept[j] & ~kept[i]]])
            n += np.bincount(hit, minlength=len(n))
        at = np.flatnonzero(n)
        yield {"at": at, "id": ids[at], "n": n[at]}

    tiles = _tiled(rows, by, threshold, cell_rows, chunk_rows)
    found = _in_tiles(tiles, [*by, *TILE], flag, by, "id BIGINT, n BIGINT")
    return found.groupBy(*by, "id").agg(F.sum("n").alias("n"))


def _edges(rows: DataFrame, by: list[str], threshold: float, cell_rows: int, chunk_rows: int) -> DataFrame:
    """Pairs of distinct vectors above the threshold: (by, first, second), by key order. Vectors are compared once."""

    def compare(group: pa.Table) -> Iterator[dict]:
        ids = group["id"].to_numpy()
        for i, j, _ in _matches(group, threshold):
            yield {"at": i, "first": np.minimum(ids[i], ids[j]), "second": np.maximum(ids[i], ids[j])}

    tiles = _tiled(rows, by, threshold, cell_rows, chunk_rows)
    return _in_tiles(tiles, [*by, *TILE], compare, by, "first BIGINT, second BIGINT")


def _block(group: pd.DataFrame, by: list[str], n: int) -> dict[str, pd.Series]:
    """The group's block keys, n times, as plain objects (Spark wants unchunked text columns)."""
    return {b: pd.Series([group[b].iloc[0]] * n, dtype=object) for b in by}


def first_independent(edges: DataFrame, by: list[str], local_edges: int = LOCAL_EDGES) -> DataFrame:
    """The vertices (by, id) that the greedy rule drops: those with an edge from an earlier vertex that is kept.

    A block of at most ``local_edges`` edges is settled by one task in one pass over its edges, so a long chain takes no rounds. In
    a larger one every vertex without an earlier neighbour is kept at once and its neighbours are dropped, in rounds of
    messages over the edges that are left, until few enough are.
    """

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        names, place = np.unique(np.concatenate([group["first"], group["second"]]), return_inverse=True)
        first, second = place[: len(group)], place[len(group) :]
        order = np.argsort(second, kind="stable")
        gone = bytearray(len(names))
        # Edges in order of their later end: the earlier end is settled before it is asked.
        for a, b in zip(first[order].tolist(), second[order].tolist(), strict=True):
            if not gone[a]:
                gone[b] = 1
        hit = names[np.frombuffer(gone, np.uint8).astype(bool)]
        return pd.DataFrame(_block(group, by, len(hit)) | {"id": hit})

    dropped, schema = None, _schema_of(edges, by, "id BIGINT")
    edges = checkpoint(edges)
    while True:
        sizes = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        sized = join_on(edges, lookup(sizes), by)
        few = sized.where(F.col("__n") <= local_edges).drop("__n")
        done = checkpoint(few.groupBy(*by).applyInPandas(settle, schema))
        dropped = done if dropped is None else dropped.unionByName(done)
        many = checkpoint(sized.where(F.col("__n") > local_edges).drop("__n"))
        if many.isEmpty():
            return dropped
        later = many.select(*by, F.col("second").alias("first")).distinct()
        kept = _without(many.select(*by, "first").distinct(), later, [*by, "first"])
        gone = checkpoint(join_on(many, kept, [*by, "first"], "left_semi").select(*by, F.col("second").alias("id")).distinct())
        dropped = dropped.unionByName(gone)
        edges = _without(many, gone.withColumnRenamed("id", "first"), [*by, "first"])
        edges = checkpoint(_without(edges, gone.withColumnRenamed("id", "second"), [*by, "second"]))


def _without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Anti join where null matches null."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__{k}"])
        same = one if same is None else same & one
    return left.join(renamed, same, "left_anti")


def _first_kept(rows: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """The first ``FIRST_ROWS`` rows of each block, settled in one task: adds kept."""
    order = Window.partitionBy(*by).orderBy("id")
    first = rows.select(*by, "id").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= FIRST_ROWS).drop("__r")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).sort_by("id").combine_chunks()
        vectors = _vectors(group["vec"].chunk(0))
        gone = np.zeros(len(vectors), bool)
        for i in range(len(vectors)):
            if not gone[i]:
                gone[i + 1 :] |= vectors[i + 1 :] @ vectors[i] > threshold
        yield from group.append_column("kept", pa.array(~gone)).to_batches()

    schema = T.StructType([*rows.schema.fields, T.StructField("kept", T.BooleanType())])
    return checkpoint(join_on(rows, lookup(first), [*by, "id"], "left_semi").groupBy(*by).applyInArrow(settle, schema))


def _beyond(rows: DataFrame, first: DataFrame, by: list[str], threshold: float, chunk_rows: int) -> DataFrame:
    """The rows outside ``first`` that are not too similar to a kept one of it. Each row is sent once, to a chunk of its block."""
    rest = _without(rows, first.select(*by, "id"), [*by, "id"])
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("__chunks"))
    sizes = lookup(sizes)
    rest = join_on(rest, sizes, by).withColumn("chunk", (draws.draw("chunk", F.col("id")) % F.col("__chunks")).cast("int"))
    kept = join_on(first.where("kept").drop("kept"), sizes, by).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    both = rest.withColumns({"a": F.lit(0), "b": F.lit(1), "__side": F.lit(1)}).unionByName(
        kept.withColumns({"a": F.lit(0), "b": F.lit(1), "__side": F.lit(0)})
    )
    names, schema = rows.columns, rows.schema

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).combine_chunks()
        side = group["__side"]
        gone = side.to_numpy() == 0
        for _, j, _ in _matches(group.drop(["chunk"]).append_column("chunk", side).combine_chunks(), threshold):
            gone[j] = True
        yield from group.select(names).filter(pa.array(~gone)).to_batches()

    return checkpoint(both.drop("__chunks").groupBy(*by, "chunk").applyInArrow(stay, schema))


def dedup_greedy(
    df: DataFrame,
    key: str,
    vector: str,
    by: list[str],
    threshold: float = 0.99,
    eligible=None,
    cell_rows: int = CELL_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows in key order are dropped iff an earlier *kept* row of the block is too similar.

    The first rows of each block are settled and the others compared with those of them that are kept, again and again while
    that drops half of what is left: in a dense block, whose few kept rows reach most others, no pair is listed. Then
    vectors are compared once and the pairs found become an edge table, on which the rule is settled. Pairs are counted
    before they are listed: while there are more than ``EDGES_PER_ROW`` for a vector, a round over the vectors goes first, which keeps
    those without an earlier neighbour and drops their neighbours, and so thins a dense group out without a pair
    table. Rows outside ``eligible`` are always kept.
    """
    pool = df if eligible is None else df.where(eligible)
    undecided = checkpoint(distinct_vectors(pool, key, vector, by))
    # Decided ids are appended to one table, so the plan of a round does not grow with the rounds before it.
    decided = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    names = undecided.select(*by, "id").schema
    n, halved = undecided.count(), True
    while True:
        later = None
        # So few vectors cannot have more pairs than the bound; otherwise pairs are counted.
        if n * (n - 1) // 2 > max(EDGES_PER_ROW * n, LOCAL_EDGES):
            if halved:
                first = _first_kept(undecided, by, threshold)
                first.where("kept").select(*by, "id").write.mode("append").parquet(decided)
                undecided = _beyond(undecided, first, by, threshold, chunk_rows)
                before, n = n, undecided.count()
                halved = 2 * n <= before
                continue
            later = checkpoint(_flagged(undecided, by, threshold, cell_rows, chunk_rows, "earlier"))
        if later is None or (later.agg(F.sum("n")).first()[0] or 0) <= EDGES_PER_ROW * n:
            dropped = first_independent(_edges(undecided, by, threshold, cell_rows, chunk_rows), by)
            _without(undecided.select(*by, "id"), dropped, [*by, "id"]).write.mode("append").parquet(decided)
            break
        fresh = join_on(undecided, later.select(*by, "id", F.lit(True).alias("__l")), [*by, "id"], "left")
        marked = checkpoint(fresh.withColumn("kept", F.col("__l").isNull()).drop("__l"))
        marked.where("kept").select(*by, "id").write.mode("append").parquet(decided)
        gone = _flagged(marked, by, threshold, cell_rows, chunk_rows, "kept").drop("n")
        undecided = checkpoint(_without(marked.where(~F.col("kept")).drop("kept"), gone, [*by, "id"]))
        n = undecided.count()
    kept = df.sparkSession.read.schema(names).parquet(decided).select(F.col("id").alias(key))
    survivors = pool.join(kept, key, "left_semi")
    if eligible is None:
        return survivors
    return df.where(~F.coalesce(eligible, F.lit(False))).unionByName(survivors)


def dedup_one_shot(
    df: DataFrame,
    key: str,
    vector: str,
    by: list[str],
    threshold: float = 0.95,
    cell_rows: int = CELL_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows are dropped iff *any* earlier row of the block, kept or not, is too similar."""
    rows = checkpoint(distinct_vectors(df, key, vector, by))
    later = _flagged(rows, by, threshold, cell_rows, chunk_rows, "earlier").drop("n")
    kept = rows.join(later, [*by, "id"], "left_anti").select(F.col("id").alias(key))
    return df.join(kept, key, "left_semi")


def centroids(df: DataFrame, by: str, vector: str) -> DataFrame:
    """The mean vector per category as (category, dim, value); one mergeable aggregate."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    as_vector = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    mean = df.select(by, as_vector.alias("__v")).groupBy(by).agg(Summarizer.mean(F.col("__v")).alias("m"))
    return mean.select(by, F.posexplode(vector_to_array("m")).alias("dim", "value"))


def centroid_cosines(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Cosine of every two category centroids: a sparse-matrix product joined on dimension."""
    c = checkpoint(centroids(df, by, vector))
    a = c.select(F.col(by).alias("category_a"), "dim", F.col("value").alias("x"))
    b = c.select(F.col(by).alias("category_b"), "dim", F.col("value").alias("y"))
    dot = a.join(b, "dim").groupBy("category_a", "category_b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    length = c.groupBy(by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("len"))
    la = length.select(F.col(by).alias("category_a"), F.col("len").alias("len_a"))
    lb = length.select(F.col(by).alias("category_b"), F.col("len").alias("len_b"))
    return (
        dot.join(la, "category_a")
        .join(lb, "category_b")
        .select("category_a", "category_b", (F.col("dot") / (F.col("len_a") * F.col("len_b"))).alias("cosine"))
    )
