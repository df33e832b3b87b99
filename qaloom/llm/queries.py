"""Queries of this package over the whole tables, and SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from qaloom.llm import byte_bpe, decontaminate, language, licenses, lm_score, nearest, packing, quality, resharding, simhash, token_counts, turn_repair, va_file
from qaloom.llm.common import new_folder, read


def op1_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    vectors = read(spark, sf, "embeddings")
    return nearest.nearest(vectors, vectors.select("vec_id").filter("vec_id % 20 = 0"))


OLD_SHARDS = 16


def op2_reshard(spark: SparkSession, sf: str) -> DataFrame:
    """Shard and slot of every document, from 16 old shards of input files to 8 new ones with equal counts."""
    docs = read(spark, sf, "documents")
    old = F.pmod(F.crc32(F.col("_metadata.file_name")), F.lit(OLD_SHARDS))
    placed, plan = resharding.place(resharding.prepare(docs, old), 8)
    rows = resharding.rewrite(placed, plan, new_folder(spark, "op2-shards"))
    return rows.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("old").alias("old_shard"),
    )


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Words, base places, labels and permission score of every document."""
    return licenses.digest(licenses.scan(read(spark, sf, "documents")))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count(read(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf, "labels")))


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontaminate.digest(decontaminate.scan(read(spark, sf, "documents"), read(spark, sf, "benchmark")))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.digest(simhash.classes(read(spark, sf, "documents")))


def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language and score of every document."""
    docs = read(spark, sf, "documents")
    return language.identify(docs, language.fit(docs))


def op9_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-entropy difference of every document: conversations are the target, documents the background."""
    return lm_score.score_background(read(spark, sf, "conversations"), read(spark, sf, "documents"))


def op10_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.digest(packing.pack(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op11_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation."""
    return turn_repair.repair(read(spark, sf, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document, and the bytes they decode to, as checksums."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest(byte_bpe.encode(read(spark, sf, "documents"), ranks, decoded=True))


def op13_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster, exact distance and inertia of every vector: 16 centroids, three rounds."""
    return va_file.digest(*va_file.cluster(read(spark, sf, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_reshard": op2_reshard,
    "op3_license_scan": op3_license_scan,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_cross_entropy": op9_cross_entropy,
    "op10_pack": op10_pack,
    "op11_repair": op11_repair,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_centroids": op13_centroids,
}
ORACLES: dict[str, str] = {"op6_decontaminate": decontaminate.ORACLE}
