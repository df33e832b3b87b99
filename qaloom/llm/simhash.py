"""SimHash near-duplicates through a binary trie self-join.

Fingerprints of whole texts are reduced to the distinct ones, so copies meet in one partial aggregation. Two
fingerprints within ``RADIUS`` = 3 bits differ in at most one bit of their upper or of their lower half. So the distinct ones form
two tries, one led by either half, and each is joined with itself: pairs of nodes are followed down together, their
differing bits are added up, and a pair is dropped as soon as it exceeds the budget: 1 bit on the leading 32 levels, 3 on
all 64. No link is lost.

The upper levels are Spark joins of node pairs with the counts of their children, ``STEP`` bits at a time, only for pairs that
hold more than ``LEAF`` fingerprints; so dense regions of any size are split further. What is left are bounded subtrees, which
tasks follow down in numpy. A task returns a spanning forest of the links it found: at most one row per
fingerprint, never all pairs of a dense group; components of links are the same.

Rows: a null text has no words and fingerprint zero, like an empty one; a null ``doc_id`` never names a component unless all
its members lack one (then null); repeated rows count each for itself; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import doc_texts, map_batches, spaced_words, stored, utf8
from qaloom.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
HALF_RADIUS = RADIUS // 2
STEP = 4
LEAF = 4096
CHUNK = 400_000  # node pairs a task follows at once
SLICE = 65_536  # shingles whose bits a task counts at once


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64 bits as an unsigned number; bit by bit the majority over the hashes of all shingles."""
    from xxhash import xxh64_digest

    split = spaced_words(text)
    if not split:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(split) - width + 1)
    for at in range(0, n, SLICE):
        part = split[at : min(at + SLICE, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if n > 1 or len(split) >= width else [b" ".join(split)]
        hashes = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(SEED))), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([_signed(fingerprint(t)) for t in utf8(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    return map_batches(doc_texts(docs), run, "doc_id bigint, fp bigint")


def _prefix(key: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth < 64 else F.col(key)


def _bound(depth: int) -> int:
    return HALF_RADIUS if depth <= 32 else RADIUS


def _subtree_pairs(keys: DataFrame, leaf: int) -> list[tuple[int, DataFrame]]:
    """Node pairs (a, b, err) by depth that together hold every link and at most ``leaf`` fingerprints each."""
    spark = keys.sparkSession
    n = keys.count()
    pairs = spark.createDataFrame([(0, 0, 0)], "a bigint, b bigint, err int")
    depth, found, first = 0, [], n <= leaf
    if first:
        return [(0, pairs)]
    while depth < 64:
        depth += STEP
        nodes = keys.groupBy(_prefix("key", depth).alias("node")).agg(F.count("*").alias("n"))
        # The root's children have no sign to lose, deeper ones are shifted without one.
        nodes = nodes.withColumn("parent", F.shiftrightunsigned("node", STEP) if depth > STEP else F.lit(0).cast("bigint"))
        left = nodes.select(F.col("node").alias("ca"), F.col("n").alias("na"), F.col("parent").alias("a"))
        right = nodes.select(F.col("node").alias("cb"), F.col("n").alias("nb"), F.col("parent").alias("b"))
        low = (1 << STEP) - 1
        differing = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit(low)))
        below = pairs.join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb")))
        below = below.select(
            F.col("ca").alias("a"), F.col("cb").alias("b"), (F.col("err") + differing).cast("int").alias("err"), "na", "nb"
        ).filter(F.col("err") <= _bound(depth))
        below = stored(below, "op7-pairs")
        small = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb")) <= leaf
        done = small if depth < 64 else F.lit(True)
        found.append((depth, below.filter(done).select("a", "b", "err")))
        pairs = below.filter(~done).select("a", "b", "err")
        if pairs.isEmpty():
            break
    return found


def _forest(roots: np.ndarray, u: np.ndarray, v: np.ndarray, links: list) -> None:
    """Joins ``u`` and ``v`` in the union-find ``roots``; appends each link that joined two parts."""

    def top(x: np.ndarray) -> np.ndarray:
        while True:
            up = roots[x]
            if (up == x).all():
                return x
            x = up

    while len(u):
        a, b = top(u), top(v)
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        # One link for each root that gives way; the rest meet the next round.
        _, first = np.unique(high, return_index=True)
        roots[high[first]] = low[first]
        links.append(np.stack([u[first], v[first]], axis=1))


def follow(left: np.ndarray, right: np.ndarray | None, depth: int, err: int) -> np.ndarray:
    """A spanning forest of the links between two subtrees (or within one), as rows of fingerprints.

    Keys are sorted, distinct and unsigned; nodes are ranges of them.
    """
    a_keys, same = left, right is None
    b_keys = left if same else right
    zeros = []
    for keys in (a_keys, b_keys):
        bits = np.unpackbits(keys.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        zeros.append(np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits == 0, axis=0, dtype=np.int32)]))
    roots = np.arange(len(a_keys) + (0 if same else len(b_keys)))
    shift = 0 if same else len(a_keys)
    links: list[np.ndarray] = []
    # Depth first over chunks of node pairs: columns are low a, high a, low b, high b, differing bits.
    stack = [(depth, np.array([[0, len(a_keys), 0, len(b_keys), err]], np.int64))]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > CHUNK:
            stack.extend((level, pairs[i : i + CHUNK]) for i in range(0, len(pairs), CHUNK))
            continue
        alone = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if level == 64:
            alone[:] = True
        if alone.any():
            u, v = pairs[alone, 0], pairs[alone, 2]
            close = np.bitwise_count(a_keys[u] ^ b_keys[v]) <= RADIUS
            if same:
                close &= u != v
            _forest(roots, u[close], v[close] + shift, links)
            pairs = pairs[~alone]
        if not len(pairs):
            continue
        ranges = []
        for k, z in enumerate(zeros):
            low, high = pairs[:, 2 * k], pairs[:, 2 * k + 1]
            middle = low + z[high, level] - z[low, level]
            ranges.append(((low, middle), (middle, high)))
        below = []
        for x in (0, 1):
            for y in (0, 1):
                child = np.stack([*ranges[0][x], *ranges[1][y], pairs[:, 4] + (x != y)], axis=1)
                keep = (child[:, 0] < child[:, 1]) & (child[:, 2] < child[:, 3]) & (child[:, 4] <= _bound(level + 1))
                if same:  # a node met with itself: its two halves meet once
                    itself = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3])
                    keep &= ~(itself & (x > y))
                    keep &= ~((child[:, 0] == child[:, 2]) & (child[:, 1] - child[:, 0] == 1) & (child[:, 3] - child[:, 2] == 1))
                below.append(child[keep])
        stack.append((level + 1, np.concatenate(below)))
    every = a_keys if same else np.concatenate([a_keys, b_keys])
    return every[np.concatenate(links)] if links else np.zeros((0, 2), np.uint64)


def _join_subtrees(key: tuple, rows: pa.Table) -> pa.Table:
    depth, a, b, err = (k.as_py() for k in key)
    keys = rows["key"].to_numpy().astype(np.int64).view(np.uint64)
    side = rows["side"].to_numpy()
    left = np.sort(keys[side == 0])
    right = None if a == b else np.sort(keys[side == 1])
    links = follow(left, right, depth, err).view(np.int64)
    return pa.table({"u": links[:, 0], "v": links[:, 1]})


def _trie_links(keys: DataFrame, leaf: int) -> DataFrame:
    sides = []
    for depth, pairs in _subtree_pairs(keys, leaf):
        node = _prefix("key", depth) if depth else F.lit(0).cast("bigint")
        at = keys.select("key", node.alias("node"))
        for side, name in enumerate("ab"):
            wanted = pairs if name == "a" else pairs.filter("a <> b")
            met = wanted.withColumn("node", F.col(name)).join(at, "node")
            sides.append(met.select(F.lit(depth).alias("depth"), "a", "b", "err", "key", F.lit(side).alias("side")))
    rows = sides[0]
    for more in sides[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("depth", "a", "b", "err").applyInArrow(_join_subtrees, "u bigint, v bigint")


def links(distinct: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Links ``u``, ``v`` whose components are those of all pairs of the distinct ``fp`` within the radius."""
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    upper = _trie_links(distinct.select(F.col("fp").alias("key")), leaf)
    lower = _trie_links(distinct.select(turned.alias("key")), leaf)
    back = [F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32)).alias(c) for c in ("u", "v")]
    return upper.unionByName(lower.select(*back))


def classes(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (least ``doc_id`` of the component) of every row."""
    rows = stored(fingerprints(docs), "op7-rows")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "op7-distinct")
    found = components(links(distinct, leaf))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(by_fp, rows["fp"] == by_fp["__fp"]).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that have the least ``doc_id`` of their component; rows without one stay."""
    later = classes(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("__later")).distinct()
    return docs.join(later, docs["doc_id"] == later["__later"], "left_anti")
