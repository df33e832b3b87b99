"""Queries that send given tables through the sinks and read them back from a fresh shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qaloom import schemas
from qaloom.operators import features, gates
from qaloom.plans import tables as T
from qaloom.plans.registry import query
from qaloom.session import shared_folder
from qaloom.sources import readers, writers


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_a4_csv", "SELECT event_id, user_id, event_type, value FROM events")
def a1(spark, sf):
    """Events without line breaks: written as CSV and read back in splits."""
    path = _folder(spark, "a1")
    writers.write_csv(T.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), path)
    return readers.read_csv(spark, path, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE", multi_line=False)


@query("a2_unknown_separator", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def a2(spark, sf):
    """Customers in a CSV whose separator the reader has to find."""
    path = _folder(spark, "a2")
    writers.write_csv(T.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, ";")
    return readers.read_csv_any(spark, path, "c_custkey BIGINT, c_name STRING, c_mktsegment STRING", multi_line=False)


@query("a3_csv_texts", "SELECT doc_id, md5(text) AS digest, lang FROM documents")
def a3(spark, sf):
    """Whole texts with quotes, commas and line breaks through CSV."""
    path = _folder(spark, "a3")
    writers.write_csv(T.table(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return readers.read_csv(spark, path, "doc_id BIGINT, text STRING, lang STRING").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("a5_json_documents", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def a5(spark, sf):
    """Conversation turns as JSON documents, one a line."""
    path = _folder(spark, "a5")
    writers.write_document(T.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path)
    back = spark.read.schema("conv_id BIGINT, turn BIGINT, role STRING, text STRING").json(path)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("a8_embedding_store", "SELECT vec_id FROM embeddings WHERE label % 3 = 0")
def a8_store(spark, sf):
    """A store that lacks a third of the labels: the keys without an embedding are found."""
    rows, path = T.table(spark, sf, "embeddings"), _folder(spark, "a8")
    writers.write_embeddings(rows.where(F.col("label") % 3 != 0), path, "vec_id", "embedding")
    return features.check_embeddings(rows, spark.read.parquet(path), "vec_id")


@query(
    "v6_v7_summary",
    "SELECT count(*) AS n_rows, count(DISTINCT lang) AS n_langs, sum(n_chars)::BIGINT AS n_chars FROM documents",
)
def v6(spark, sf):
    """Required columns and rows are there; named facts as one JSON document, read back."""
    rows = schemas.require_rows(schemas.require_columns(T.table(spark, sf, "documents"), ["doc_id", "lang", "n_chars"]))
    facts = gates.summary_document(
        rows, n_rows=F.count(F.lit(1)), n_langs=F.countDistinct("lang"), n_chars=F.sum("n_chars").cast("bigint")
    )
    path = _folder(spark, "v6")
    writers.write_document(facts, path)
    return spark.read.schema("n_rows BIGINT, n_langs BIGINT, n_chars BIGINT").json(path)
