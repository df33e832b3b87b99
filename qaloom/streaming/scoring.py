"""Symbolic answers over a stream of conversations.

All facts of a nested conversation are column expressions, so the same code that scores a table
scores a stream: there is no state, no watermark and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom import schemas
from qaloom.operators.conversations import nested_features, parse_conversation, symbolic_answer


def read_pairs(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of evaluation pairs from JSON-lines files as they arrive."""
    reader = spark.readStream.schema(schemas.PAIR)
    return reader.option("maxFilesPerTrigger", files_per_trigger).json(path)


def scored(pairs: DataFrame, mode: str = "production") -> DataFrame:
    """Adds ``answer``; works on a table and on a stream alike."""
    parsed = pairs.withColumn("__c", parse_conversation(F.col("conversation_json")))
    featured = nested_features(parsed, "__c")
    answer = symbolic_answer(F.col("category"), F.col("params"), mode)
    return featured.select(*pairs.columns, answer.alias("answer"))
