"""Approximate nearest neighbours by largest inner product: a graph from NN-descent, greedy search on it.

Equal vectors are one node (its least id); shorter vectors count as padded with zeros. NN-descent starts from small cells
around sampled pivots and repeats one Spark join: each node meets the vectors of its neighbours and of nodes it
is a neighbour of, all pairs with a new member are compared, and whatever beats a node's current worst neighbour joins its
list. It ends when fewer than ``DELTA`` of the entries change. While the graph is built, vectors are 8-bit codes with a
scale each; scores of the search are exact, in double precision.

A search keeps the ``BEAM`` best nodes found for each query and expands the best unexpanded ones, round by round, until none is left; it starts at
the query's own node and at the best pivots. Candidates go to the vectors, which are written once in buckets and never shuffled again; queries are
taken in blocks whose vectors are broadcast (at most ``BLOCK`` of them). Of equal scores the smaller id is nearer, in lists, beams and results.

Bounds: a cell has about ``CELL`` nodes (denser cells are split by hash), a node's list ``NEIGHBOURS`` entries, and
``REVERSE`` nodes that point to it take part in a round (drawn anew each round, so that popular nodes are no hot spot); a comparison offers each
node its ``OFFERS`` best, and a node takes ``4 * NEIGHBOURS`` offers a round, repeats included; a beam has ``BEAM`` entries; these bound the
work of the approximation, not the rows: every vector is indexed. A class of equal vectors is expanded to its smallest ids only when
the result is written, which is exact.

Rows: vectors that are null, zero, or hold null or non-finite components take no part, neither do null ids; repeated
ids with different vectors are candidates each for itself; fewer candidates than asked for are all returned; empty tables give no rows; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.llm.common import new_folder, stored

NEIGHBOURS = 32
REVERSE = 24
PIVOTS = 512
GROUPINGS = 3
CELL = 500
DELTA = 0.005
OFFERS = 6  # candidates a comparison offers to each of its nodes
BEAM = 256
WIDTH = 48  # nodes a query expands in a round
BLOCK = 8192
NODES_PER_TASK = 8192
MOST_BUCKETS = 50_000


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _codes(vectors: np.ndarray) -> list[bytes]:
    """A float32 scale and int8 components of each vector."""
    scale = np.abs(vectors).max(axis=1, keepdims=True) / 127
    codes = np.rint(vectors / scale).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale.astype(np.float32), codes, strict=True)]


def _decoded(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _exact(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def index_rows(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (node, exact, code), members (vec_id, node) and the number of nodes."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")
    ).filter(F.col("vec_id").isNotNull() & _usable(F.col("e")))
    width = rows.agg(F.max(F.size("e"))).first()[0] or 1
    padded = F.concat("e", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("e")))
    rows = rows.withColumn("e", F.transform(padded, lambda x: x + 0.0))  # minus zero is zero
    rows = rows.withColumn("h1", F.xxhash64("e")).withColumn("h2", F.xxhash64(F.lit(1), "e"))
    first = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.min_by("e", "vec_id").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e = batch.column("e").flatten().to_numpy().reshape(batch.num_rows, -1)
                columns = [batch.column(c) for c in ("node", "h1", "h2")]
                exact = pa.array([v.tobytes() for v in e], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, exact, pa.array(_codes(e), pa.binary())], ["node", "h1", "h2", "exact", "code"])

    # Two different vectors with one id are two nodes: the later one takes a negative name.
    nodes = stored(first.mapInArrow(run, "node bigint, h1 bigint, h2 bigint, exact binary, code binary"), "op1-nodes")
    again = Window.partitionBy("node").orderBy("h1", "h2")
    place = F.row_number().over(again)
    nodes = stored(nodes.withColumn("node", F.when(place == 1, F.col("node")).otherwise(-1 - F.abs(F.xxhash64("h1", "h2") / 2).cast("bigint"))), "op1-named")
    members = rows.select("vec_id", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("vec_id", "node")
    return nodes.select("node", "exact", "code"), stored(members, "op1-members"), nodes.count()


def _best(rows: DataFrame, by: str, score: str, tie: str, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return rows.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def _cells(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The pivot nearest in angle for each node, in each of ``GROUPINGS`` groups of pivots."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _decoded(batch.column("code").to_pylist()) @ shared.value.T
            for g in range(GROUPINGS):
                group = found[:, g::GROUPINGS]
                if group.shape[1]:
                    cell = (group.argmax(axis=1) * GROUPINGS + g).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(cell)], ["node", "code", "cell"])

    return nodes.select("node", "code").mapInArrow(run, "node bigint, code binary, cell bigint")


def _within_cell(rows: pd.DataFrame) -> pd.DataFrame:
    ids = rows["node"].to_numpy()
    x = _decoded(rows["code"].tolist())
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(NEIGHBOURS, len(ids) - 1)
    if k < 1:
        return pd.DataFrame({"u": [], "v": [], "s": []}).astype({"u": "int64", "v": "int64", "s": "float32"})
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return pd.DataFrame({"u": np.repeat(ids, k), "v": ids[at].ravel(), "s": np.take_along_axis(s, at, axis=1).ravel()})


def _lists(found: DataFrame, nodes: DataFrame, fresh: bool) -> DataFrame:
    """One row per node: u, code and its best entries (s, v, fresh), best first."""
    kept = _best(found.groupBy("u", "v").agg(F.max("s").alias("s")), "u", "s", "v", NEIGHBOURS)
    entry = F.struct((-F.col("s")).alias("far"), "v", F.lit(fresh).alias("fresh"))
    return kept.groupBy("u").agg(F.sort_array(F.collect_list(entry)).alias("list")).join(
        nodes.select(F.col("node").alias("u"), "code"), "u"
    )


def _first_graph(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    cells = stored(_cells(nodes, pivots), "op1-cells")
    sizes = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}  # at most PIVOTS
    parts = F.element_at(F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, max(1, round(n / CELL)))]), F.col("cell"))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("node", "cell"), parts))
    found = cells.groupBy("cell", "part").applyInPandas(_within_cell, "u bigint, v bigint, s float")
    return _lists(found, nodes, True)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per centre: compares its members and offers each the best it may want."""
    for batch in batches:
        lists = batch.column("members")
        ends = lists.offsets.to_numpy()
        flat = lists.flatten()
        if not len(flat):
            continue
        base = ends[0]
        ids, fresh, worst = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "fresh", "worst"))
        x = _decoded(flat.field("code").to_pylist())
        out: list[list[np.ndarray]] = [[], [], []]
        for a, b in zip(ends[:-1] - base, ends[1:] - base, strict=True):
            s = x[a:b] @ x[a:b].T
            wanted = (fresh[a:b, None] | fresh[None, a:b]) & (s >= worst[a:b, None]) & (ids[a:b, None] != ids[None, a:b])
            s[~wanted] = -np.inf
            k = min(OFFERS, b - a)
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(s, at, axis=1)
            row, column = np.nonzero(best > -np.inf)
            out[0].append(ids[a:b][row])
            out[1].append(ids[a:b][at[row, column]])
            out[2].append(best[row, column])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["u", "v", "s"])


def _round(graph: DataFrame, number: int) -> DataFrame:
    """One join of neighbours of neighbours; three shuffles of links, two of lists."""
    worst = F.when(F.size("list") >= NEIGHBOURS, -F.element_at("list", -1)["far"]).otherwise(F.lit(float("-inf"))).cast("float")
    known = graph.select(F.col("u").alias("x"), "code", worst.alias("worst"))
    links = graph.select("u", F.inline("list")).select("u", "v", "fresh")
    forward = links.select(F.col("u").alias("centre"), F.col("v").alias("x"), "fresh")
    backward = links.select(F.col("v").alias("centre"), F.col("u").alias("x"), "fresh")
    # New ones first, then by a hash that differs from round to round.
    draw = F.row_number().over(Window.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64(F.lit(number), "x")))
    backward = backward.withColumn("place", draw).filter(F.col("place") <= REVERSE).drop("place")
    met = forward.unionByName(backward).join(known, "x")
    members = met.groupBy("centre").agg(F.collect_list(F.struct("x", "fresh", "worst", "code")).alias("members"))
    offers = members.select("members").mapInArrow(_compare, "u bigint, v bigint, s float")
    # The best offers are enough: a list takes at most NEIGHBOURS, and the same offer comes from few centres.
    offers = _best(offers, "u", "s", "v", 4 * NEIGHBOURS)
    offered = offers.groupBy("u").agg(F.collect_set(F.struct("s", "v")).alias("offers"))
    merged = graph.join(offered, "u", "left")
    old = F.transform("list", lambda e: F.struct(e["far"].alias("far"), e["v"].alias("v"), F.lit(False).alias("fresh")))
    names = F.transform("list", lambda e: e["v"])
    new = F.filter(F.coalesce("offers", F.array()), lambda o: ~F.array_contains("names", o["v"]))
    new = F.transform(new, lambda o: F.struct((-o["s"]).alias("far"), o["v"].alias("v"), F.lit(True).alias("fresh")))
    entries = F.slice(F.sort_array(F.concat(old, new)), 1, NEIGHBOURS)
    return merged.withColumn("names", names).select("u", entries.alias("list"), "code")


def build(nodes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph (u, v, s) and the pivots (node, exact)."""
    pivots = stored(nodes.orderBy(F.xxhash64("node"), "node").limit(PIVOTS), "op1-pivots")
    sample = _exact([bytes(r["exact"]) for r in pivots.select("exact").collect()]) if n else np.zeros((1, 1))
    sample = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32) if n else sample
    if n < 2:
        return nodes.sparkSession.createDataFrame([], "u bigint, v bigint, s float"), pivots
    graph = stored(_first_graph(nodes, sample[: max(1, min(PIVOTS, n // (CELL // 2)))]), "op1-graph")
    number = 0
    while True:
        number += 1
        graph = stored(_round(graph, number), "op1-graph")
        changed = F.size(F.filter("list", lambda e: e["fresh"]))
        entries, changed = graph.agg(F.sum(F.size("list")), F.sum(changed)).first()
        if not entries or changed <= DELTA * entries:
            return graph.select("u", F.inline("list")).select("u", "v", (-F.col("far")).alias("s")), pivots


def _dealt(column: str, tasks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(tasks)).cast("int").alias("task")


def _dealt_nodes(nodes: DataFrame, tasks: int) -> tuple[DataFrame, str]:
    """The exact vectors, written once in buckets by task, so that no round of a search shuffles them; and the table's name."""
    folder = new_folder(nodes.sparkSession, "op1-dealt")
    name = "qaloom_" + folder.rsplit("/", 1)[1].replace("-", "_")
    buckets = min(tasks, MOST_BUCKETS)
    dealt = nodes.select("node", "exact", _dealt("node", tasks)).repartition(buckets, "task")
    dealt.write.format("parquet").option("path", folder).bucketBy(buckets, "task").sortBy("task").saveAsTable(name)
    return nodes.sparkSession.table(name), name


def _scored(pairs: DataFrame, dealt: DataFrame, tasks: int, names: np.ndarray, queries: np.ndarray) -> DataFrame:
    """Exact scores of (q, w) that beat the end of the beam (``worst``, ``worst_w``); candidates go to the tasks that hold their vectors."""
    shared = pairs.sparkSession.sparkContext.broadcast((names, queries))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, queries = shared.value
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "w": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        left = left.drop_duplicates(["q", "w"])
        order = np.argsort(right["node"].to_numpy())
        ids, x = right["node"].to_numpy()[order], _exact(right["exact"].tolist())[order]
        q, w = left["q"].to_numpy(), left["w"].to_numpy()
        at, of = np.searchsorted(ids, w), np.searchsorted(names, q)
        score = np.empty(len(q))
        for i in range(0, len(q), 100_000):
            score[i : i + 100_000] = np.einsum("ij,ij->i", queries[of[i : i + 100_000]], x[at[i : i + 100_000]])
        worst = left["worst"].to_numpy()
        keep = (score > worst) | (score == worst) & (w < left["worst_w"].to_numpy())
        return pd.DataFrame({"q": q[keep], "w": w[keep], "score": score[keep]})

    left = pairs.select("q", "w", "worst", "worst_w", _dealt("w", tasks))
    return left.groupBy("task").cogroup(dealt.groupBy("task")).applyInPandas(run, "q bigint, w bigint, score double")


# ``far`` is the negative score, so that ascending order puts the smaller of equally near nodes first.
BEAMS = "array<struct<far: double, w: bigint, expanded: boolean>>"


def _merged(state: DataFrame, found: DataFrame, beam: int) -> DataFrame:
    """The beams (q, beam) with what was found, best first; nodes that are in a beam already stay as they are."""
    entry = F.struct((-F.col("score")).alias("far"), "w", F.lit(False).alias("expanded"))
    found = found.groupBy("q").agg(F.collect_set(entry).alias("found"))
    held = state.join(found, "q", "left").withColumn("names", F.transform("beam", lambda e: e["w"]))
    new = F.filter(F.coalesce("found", F.array()), lambda e: ~F.array_contains("names", e["w"]))
    best = F.slice(F.sort_array(F.concat("beam", new)), 1, beam)
    return held.select("q", best.cast(BEAMS).alias("beam"))


def search(queries: DataFrame, nodes: DataFrame, n: int, graph: DataFrame, pivots: DataFrame, most: int) -> DataFrame:
    """The ``most`` best nodes found (q, w, score) for query nodes (q, exact)."""
    spark = nodes.sparkSession
    both = graph.select("u", "v", "s").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")).distinct()
    links = _best(both, "u", "s", "v", NEIGHBOURS + REVERSE).groupBy("u").agg(F.collect_list("v").alias("next"))
    links = stored(links, "op1-links")
    tasks, beam = -(-n // NODES_PER_TASK), max(BEAM, most)
    tasks = max(tasks, spark.sparkContext.defaultParallelism)
    dealt, table = _dealt_nodes(nodes, tasks)
    blocks = -(-queries.count() // BLOCK)
    done = []
    for block in range(blocks):
        # Blocks by hash hold about BLOCK queries; their vectors are what is broadcast.
        part = queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        got = part.orderBy("q").toArrow()
        names, vectors = got["q"].to_numpy(), _exact([v.as_py() for v in got["exact"]]) if len(got) else None
        if not len(got):
            continue
        ids = part.select("q")
        start = _entries(ids, names, vectors, pivots).unionByName(ids.select("q", F.col("q").alias("w")))
        start = start.withColumns({"worst": F.lit(float("-inf")), "worst_w": F.lit(0).cast("bigint")})
        found = _scored(start, dealt, tasks, names, vectors)
        state = stored(_merged(ids.withColumn("beam", F.array().cast(BEAMS)), found, beam), "op1-beam")
        while True:
            # One row per query: its beam, best first; what is open and what counts are read off it.
            opened = F.slice(F.filter("beam", lambda e: ~e["expanded"]), 1, WIDTH)
            end, full = F.element_at("beam", -1), F.size("beam") >= beam
            worst = F.when(full, -end["far"]).otherwise(F.lit(float("-inf"))).alias("worst")
            front = state.select("q", worst, F.when(full, end["w"]).otherwise(0).alias("worst_w"), F.explode(F.transform(opened, lambda e: e["w"])).alias("u"))
            if front.isEmpty():
                break
            pairs = front.join(links, "u").select("q", "worst", "worst_w", F.explode("next").alias("w"))
            new = _scored(pairs, dealt, tasks, names, vectors)
            done_now = F.transform(opened, lambda e: e["w"])
            closed = F.transform(
                "beam",
                lambda e: F.struct(
                    e["far"].alias("far"), e["w"].alias("w"), (e["expanded"] | F.array_contains("done", e["w"])).alias("expanded")
                ),
            )
            after = state.withColumn("done", done_now).select("q", closed.alias("beam"))
            state = stored(_merged(after, new, beam), "op1-beam")
        done.append(state.select("q", F.inline(F.slice("beam", 1, most))).select("q", "w", (-F.col("far")).alias("score")))
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    result = done[0] if done else spark.createDataFrame([], "q bigint, w bigint, score double")
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def _entries(ids: DataFrame, names: np.ndarray, vectors: np.ndarray, pivots: DataFrame) -> DataFrame:
    """The best few pivots of each query of a block."""
    got = pivots.select("node", "exact").toArrow()
    sample, labels = _exact([v.as_py() for v in got["exact"]]), got["node"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast((names, vectors, sample, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, sample, labels = shared.value
        k = min(8, len(labels))
        for batch in batches:
            q = batch.column("q").to_numpy()
            at = np.argpartition(-(vectors[np.searchsorted(names, q)] @ sample.T), k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, k)), pa.array(labels[at].ravel())], ["q", "w"])

    return ids.mapInArrow(run, "q bigint, w bigint")


def nearest(vectors: DataFrame, query_ids: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` nearest found of the table's rows for the rows whose ``vec_id`` is in ``query_ids``."""
    nodes, members, n = index_rows(vectors)
    graph, pivots = build(nodes, n)
    asked = stored(members.join(query_ids.select(F.col("vec_id")).distinct(), "vec_id").withColumnRenamed("vec_id", "query_id"), "op1-asked")
    queries = stored(asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("q"), "exact"), "op1-queries")
    found = search(queries, nodes, n, graph, pivots, k + 1)
    # The smallest ids of a class are enough: a class can fill a result alone.
    place = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    first = members.withColumn("place", place).filter(F.col("place") <= k + 1).select(F.col("node").alias("w"), "vec_id")
    hits = asked.join(found, asked["node"] == found["q"]).join(first, "w").filter(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
