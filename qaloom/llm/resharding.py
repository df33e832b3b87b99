"""Resharding by minimum-cost flow.

Documents lie in old shards; new shards get counts of documents that differ by at most one (law ``rows``). Rows of an old shard
fall into blocks by size; a flow decides how many rows of each block stay where they are (free) and how many move (at
the block's mean bytes), so that the capacities are met and the fewest bytes move. The flow sees blocks and shards only:
at most old shards x size classes nodes, whatever the number of rows.

Rows then get exact places: a block is cut into pieces of about ``PIECE_ROWS`` rows by a hash of the key, pieces are counted
and given their first rank, and rows are ranked within their piece; no window sees more. A row's rank in its block gives its
shard and slot. Rewriting writes the rows of affected shards (that lose or gain rows, or whose old shard goes)
to a new folder, one directory per shard; other shards keep their files.

Rows: a null text has size 1 and the checksum of the empty text; null keys are placed like others; repeated rows are
placed each for itself; an empty table gives no rows and no folder content; further columns are not read, save those
named in ``keep``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.llm.common import stored

CLASSES_PER_DOUBLING = 4
PIECE_ROWS = 20_000


class Flow:
    """A minimum-cost flow by successive shortest paths with potentials; costs are not negative."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        """Returns the edge's number; the flow on it ends up as the room on the next number."""
        for x, y, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(room)
            self.cost.append(price)
        return len(self.to) - 2

    def send(self, source: int, sink: int, amount: int) -> int:
        """Sends ``amount`` at the least cost and returns that cost."""
        potential, total = [0] * len(self.out), 0
        while amount:
            distance: list[float] = [float("inf")] * len(self.out)
            via = [-1] * len(self.out)
            distance[source] = 0
            queue: list[tuple[float, int]] = [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > distance[a]:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    if self.left[e] and (reached := d + self.cost[e] + potential[a] - potential[b]) < distance[b]:
                        distance[b] = reached
                        via[b] = e
                        heapq.heappush(queue, (reached, b))
            if via[sink] < 0:
                raise ValueError("the capacities do not take all rows")
            for node, d in enumerate(distance):
                potential[node] += int(min(d, distance[sink]))
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            step = min([amount, *(self.left[e] for e in path)])
            for e in path:
                self.left[e] -= step
                self.left[e ^ 1] += step
                total += step * self.cost[e]
            amount -= step
        return total


@dataclass(frozen=True)
class Segment:
    """Ranks from ``low`` (to below ``high``) of a block go to ``shard``, from slot ``slot`` on."""

    old: int
    size_class: int
    low: int
    high: int
    shard: int
    slot: int


@dataclass(frozen=True)
class Plan:
    shards: int
    segments: list[Segment]
    moved_bytes: int
    affected: frozenset[int]


def solve(blocks: list[tuple[int, int, int, int]], shards: int) -> Plan:
    """The transfers for blocks (old shard, size class, rows, bytes)."""
    blocks = sorted(b for b in blocks if b[2])
    rows = sum(b[2] for b in blocks)
    first = 4
    source, sink, pool, extra = range(first)
    flow = Flow(first + shards + len(blocks))
    stays, moves, takes = {}, [], []
    for k, (old, _, n, size) in enumerate(blocks):
        node = first + shards + k
        flow.edge(source, node, n, 0)
        if old < shards:
            stays[k] = flow.edge(node, first + old, n, 0)
        moves.append(flow.edge(node, pool, n, -(-size // n)))
    for s in range(shards):
        takes.append(flow.edge(pool, first + s, rows, 0))
        flow.edge(first + s, sink, rows // shards, 0)
        flow.edge(first + s, extra, 1, 0)
    flow.edge(extra, sink, rows % shards, 0)
    cost = flow.send(source, sink, rows)
    wanted = [flow.left[e ^ 1] for e in takes]
    segments, filled = [], [0] * shards
    for k, (old, size_class, _, _) in enumerate(blocks):
        low = 0
        parts = [(old, flow.left[stays[k] ^ 1])] if k in stays else []
        moving, total, passed, given = flow.left[moves[k] ^ 1], sum(wanted), 0, 0
        # Where moved rows go costs the same; each block is spread over what the shards still want, so that bytes even out too.
        for s in range(shards if moving else 0):
            passed += wanted[s]
            part = moving * passed // total - given
            given += part
            parts.append((s, part))
            wanted[s] -= part
        for shard, n in parts:
            if n:
                segments.append(Segment(old, size_class, low, low + n, shard, filled[shard]))
                filled[shard] += n
                low += n
    changed = {s.shard for s in segments if s.old != s.shard} | {s.old for s in segments if s.old != s.shard and s.old < shards}
    return Plan(shards, segments, cost, frozenset(changed))


def prepare(docs: DataFrame, old: Column, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, size, old shard and size class of every document."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        old.cast("int").alias("old"),
        *(keep or []),
    )
    return rows.withColumn("size_class", F.floor(F.log2("size") * CLASSES_PER_DOUBLING).cast("int"))


def place(rows: DataFrame, shards: int, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, Plan]:
    """``prepare``'s rows with their shard and slot, and the plan."""
    spark = rows.sparkSession
    key = F.xxhash64("doc_id")
    slim = stored(rows.select("old", "size_class", "size", key.alias("key")), "op2-keys")
    block = ["old", "size_class"]
    totals = slim.groupBy(*block).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()  # shards x classes
    plan = solve([tuple(r) for r in totals], shards)
    kinds = "old int, size_class int"
    pieces = spark.createDataFrame([(r[0], r[1], -(-r[2] // piece_rows)) for r in totals], kinds + ", pieces bigint")
    segments = spark.createDataFrame(
        [(s.old, s.size_class, s.low, s.high, s.shard, s.slot) for s in plan.segments],
        kinds + ", low bigint, high bigint, shard int, slot bigint",
    )
    # Segments per block: at most one per shard, and one more.
    segments = segments.groupBy(*block).agg(F.collect_list(F.struct("low", "high", "shard", "slot")).alias("segments"))
    blocks = F.broadcast(pieces.join(segments, block))

    def cut(df: DataFrame, key: Column) -> DataFrame:
        return df.join(blocks, block).withColumn("piece", F.pmod(key, F.col("pieces")))

    counts = cut(slim, F.col("key")).groupBy(*block, "piece").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(*block).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select(*block, "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")), "op2-starts")
    within = Window.partitionBy(*block, "piece").orderBy(key, "doc_id", F.crc32("text"))
    ranked = cut(rows, key).withColumn("within", F.row_number().over(within) - 1).join(starts, [*block, "piece"])
    rank = F.col("start") + F.col("within")
    own = F.filter("segments", lambda s: (s["low"] <= rank) & (rank < s["high"]))[0]
    placed = ranked.withColumn("own", own).withColumn("shard", F.col("own.shard"))
    placed = placed.withColumn("slot", F.col("own.slot") + rank - F.col("own.low"))
    return placed.drop("pieces", "segments", "piece", "within", "start", "own", "size_class"), plan


def rewrite(placed: DataFrame, plan: Plan, folder: str) -> DataFrame:
    """Writes the affected shards below ``folder`` (a directory ``shard=N`` each); returns the rows of all shards.

    Rows of affected shards are read back from the files, the others come from where they were.
    """
    # Rows of a shard that neither loses nor gains any are told by their old shard, before anything is shuffled.
    still = [s for s in range(plan.shards) if s not in plan.affected]
    placed.filter(~F.col("old").isin(still) | F.col("old").isNull()).write.partitionBy("shard").parquet(folder)
    schema = placed.schema
    written = placed.sparkSession.read.schema(schema).parquet(folder).select(*schema.names)
    return written.unionByName(placed.filter(F.col("old").isin(still))) if still else written
