"""Near copies by word shingles: candidates from SimHash tries and MinHash buckets, exact Jaccard similarity for links.

A text is the set of its runs of ``WIDTH`` = 5 words (all its words, if it has fewer); equal sets meet in one node. Two sets are
linked if their Jaccard similarity is ``SIMILAR`` = 0.8 or more; sets are compared whole, as 64-bit hashes. Candidates come from two sides:
SimHash fingerprints of the sets within 3 bits, by the binary trie self-join, and one of ``BANDS`` = 20 shared buckets of ``ROWS`` = 5
minima. A pair of similarity s shares no bucket with probability (1 - s^5)^20, 0.0004 at 0.8, 0.000003 at 0.85 and less above; if the tries do
not find it either, that is the one way a link can be missed.

Every pair of a bucket is settled, without a pair list of a dense group: members are first compared with the least of their
bucket, and the links found are followed to components; what is left are pairs of members in different components,
and buckets of near copies, however large, have none.

What is written for every row is small (digest, node, fingerprint, bucket keys). Only the sets of candidates are made once more, from one
text for each.

Rows: a null text has no words, like an empty one, and all these are copies of each other. Of each group one row stays: one with the least
``doc_id`` and, among several texts with it, the least digest of the text; rows without ``doc_id`` are never removed. Rows that share a
``doc_id`` but not a text are told apart; of rows that share both, one is left; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm import simhash
from qaloom.llm.common import batches_of, doc_texts, map_batches, spaced_words, stored, utf8
from qaloom.llm.components import components
from qaloom.session import lookup

WIDTH = 5
PARTS = (4, 5)  # the similarity 0.8 as a fraction
SIMILAR = PARTS[0] / PARTS[1]
BANDS, ROWS = 20, 5
SEED = 42
SLICE = 65_536  # shingles hashed at once
BLOCK = 4_096  # hashes that are permuted at once
TEXTS = 64  # texts whose sets a task holds at once
SETS = 32  # pairs of whole sets in a batch: a set is as large as its text, whatever that is
MET = 256  # pairs of one node a task is given in one piece
_DRAWS = np.random.Generator(np.random.Philox(SEED)).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
_TURNED, _FACTORS = _DRAWS[0], _DRAWS[1] | np.uint32(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the runs of ``width`` words, sorted."""
    from xxhash import xxh64_digest

    split = spaced_words(text)
    if not split:
        return np.zeros(0, np.uint64)
    if len(split) < width:
        return np.frombuffer(xxh64_digest(b" ".join(split), SEED), ">u8").astype(np.uint64)
    found = []
    for at in range(0, len(split) - width + 1, SLICE):
        part = split[at : at + SLICE + width - 1]
        runs = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        found.append(np.unique(np.frombuffer(b"".join(map(xxh64_digest, runs, repeat(SEED))), ">u8").astype(np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def buckets(hashes: np.ndarray) -> list[int]:
    """One key per band; no two bands share keys but by chance."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), BLOCK):
        np.minimum(least, ((high[at : at + BLOCK] ^ _TURNED) * _FACTORS).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the Jaccard similarity ``SIMILAR`` or more."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) * PARTS[1] < len(b) * PARTS[0]:
        return not len(b)
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both * PARTS[1] >= (len(a) + len(b) - both) * PARTS[0]


def _fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: bit by bit the majority of its hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _keyed(docs: DataFrame) -> DataFrame:
    return doc_texts(docs).withColumn("key", _text_key(F.col("text")))


def _nodes_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], pa.Array]]:
    """Parts of a batch, with their sets and the sets' digests."""
    from xxhash import xxh3_64_intdigest

    for at in range(0, batch.num_rows, TEXTS):
        part = batch.slice(at, TEXTS)
        sets = [shingles(t) for t in utf8(part)]
        yield part, sets, pa.array(np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def _signatures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets, node in _nodes_of(batch):
                columns = [
                    node,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_fingerprint(s) for s in sets], pa.int64()),
                    pa.array([buckets(s) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *columns], ["doc_id", "key", "node", "n", "fp", "keys"])

    return map_batches(_keyed(docs), run, "doc_id bigint, key binary, node bigint, n bigint, fp bigint, keys array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of ``nodes`` (node, key), each made from one text with the digest ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets, node in _nodes_of(batch):
                yield pa.RecordBatch.from_arrays([node, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    taken = _keyed(docs).select("key", "text").join(lookup(nodes.select("key"), 200_000, 64), "key", "left_semi")
    texts = taken.groupBy("key").agg(F.first("text").alias("text"))
    return stored(map_batches(texts.select("text"), run, "node bigint, hashes binary"), "near-sets")


def _beside(pairs: DataFrame, side: str, sets: DataFrame) -> DataFrame:
    """Adds the set of one side. The set of a node with very many pairs is dealt to several pieces of them."""
    many = pairs.groupBy(side).agg(F.ceil(F.count("*") / MET).cast("bigint").alias("pieces")).filter("pieces > 1")
    many = lookup(many, 1_000_000, 16)
    other = "v" if side == "u" else "u"
    piece = F.pmod(F.xxhash64(other), F.coalesce("pieces", F.lit(1))).alias(f"piece_{side}")
    dealt = pairs.join(many, side, "left").select(*pairs.columns, piece)
    held = sets.join(many.withColumnRenamed(side, "node"), "node", "left")
    held = held.select(
        F.col("node").alias(side),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("pieces", F.lit(1)) - 1)).alias(f"piece_{side}"),
        F.col("hashes").alias(f"hashes_{side}"),
    )
    return dealt.join(held, [side, f"piece_{side}"]).drop(f"piece_{side}")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u``, ``v`` of nodes that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c) for c in ("hashes_u", "hashes_v"))
            good = [
                similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                for x, y in zip(a, b, strict=True)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    pairs = stored(pairs, "near-pairs")
    met = _beside(_beside(pairs, "u", sets), "v", sets).select("u", "v", "hashes_u", "hashes_v")
    found = map_batches(met, run, "u bigint, v bigint")
    with batches_of(pairs.sparkSession, SETS):
        return stored(found, "near-links")


def _near_size(a: str, b: str) -> Column:
    return F.least(a, b) * PARTS[1] >= F.greatest(a, b) * PARTS[0]


def _trie_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs that join all nodes whose fingerprints are equal or are linked within 3 bits."""
    hubs = stored(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.max("node").alias("last")), "near-fingerprints")
    same = nodes.join(hubs.filter("hub <> last").select("fp", "hub"), "fp").filter("node <> hub")
    found = simhash.links(hubs.select("fp"))
    u, v = (hubs.select(F.col("fp").alias(s), F.col("hub").alias(f"hub_{s}")) for s in "uv")
    near = found.join(u, "u").join(v, "v").select(F.col("hub_u").alias("u"), F.col("hub_v").alias("v"))
    return same.select(F.col("node").alias("u"), F.col("hub").alias("v")).unionByName(near)


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` whose components are those of all similar pairs that share a bucket or are near in a trie.

    ``nodes``: node, key (digest of one of its texts), n, fp and keys, one row each.
    """
    entries = nodes.select("node", "n", F.explode("keys").alias("bucket"))
    hubs = entries.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.min_by("n", "node").alias("hub_n"))
    hubs = stored(hubs.filter("hub <> last").drop("last"), "near-hubs")
    members = stored(entries.join(hubs, "bucket").distinct(), "near-members")
    first = members.filter((F.col("node") != F.col("hub")) & _near_size("n", "hub_n"))
    first = first.select(F.col("node").alias("u"), F.col("hub").alias("v")).unionByName(_trie_pairs(nodes))
    first = stored(first.distinct(), "near-first")
    wanted = members.select("node").union(first.select("u")).union(first.select("v")).distinct()
    sets = _sets(docs, stored(nodes.select("node", "key").join(wanted, "node"), "near-wanted"))
    found = _verified(first, sets)

    # Pairs of different components; one of each is outside the largest component of its bucket.
    roots = components(found).withColumnRenamed("root", "part")
    parted = members.join(roots, "node", "left").withColumn("part", F.coalesce("part", "node"))
    parted = stored(parted.filter("node <> hub").select("bucket", "node", "n", "part"), "near-parted")
    shares = parted.groupBy("bucket", "part").agg(F.count("*").alias("members")).groupBy("bucket")
    mixed = shares.agg(F.max_by("part", F.struct("members", "part")).alias("main"), F.count("*").alias("parts"))
    open_ = parted.join(mixed.filter("parts > 1").drop("parts"), "bucket")
    a = open_.filter("part <> main").select("bucket", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("part").alias("pu"))
    b = open_.select("bucket", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("part").alias("pv"), "main")
    once = (F.col("pv") == F.col("main")) | (F.col("u") < F.col("v"))
    met = a.join(b, "bucket").filter((F.col("pu") != F.col("pv")) & once & _near_size("nu", "nv"))
    return found.unionByName(_verified(met.select("u", "v").distinct(), sets))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text), rows with both, and first (doc_id and key of the row that stays in their group)."""
    rows = stored(_signatures(docs), "near-rows")
    own = F.struct("doc_id", "key")
    # Of equal sets any text will do for all its facts; they are equal.
    nodes = rows.groupBy("node").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"),
        F.min(F.when(F.col("doc_id").isNotNull(), own)).alias("least"),
    )
    nodes = stored(nodes, "near-nodes")
    found = components(links(nodes, docs))
    rooted = nodes.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "near-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    first = rooted.join(named, "root").select("node", "first")
    told = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "key", "node").agg(F.count("*").alias("n"))
    return told.join(first, "node").select("doc_id", "key", "n", "first")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that stay: one row of each group of near copies, and all without ``doc_id``."""
    told = _classes(docs)
    own = F.struct("doc_id", "key")
    told = stored(told.filter((own != F.col("first")) | (F.col("n") > 1)).select(own.alias("__key"), (own == F.col("first")).alias("__stays")), "near-told")
    keyed = docs.withColumn("__key", F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key(F.col("text")).alias("key")))
    kept = keyed.join(lookup(told.select("__key"), 200_000, 96), "__key", "left_anti").drop("__key")
    # Rows that stay but are repeated: one of each.
    again = keyed.join(lookup(told.filter("__stays").select("__key"), 200_000, 96), "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
    return kept.unionByName(again)
