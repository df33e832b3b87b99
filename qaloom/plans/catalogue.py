"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qaloom.plans import (
    conversation_queries,
    curation_queries,
    evaluation_queries,
    model_queries,
    source_queries,
    text_queries,
)
from qaloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
_GROUPS = [conversation_queries, text_queries, curation_queries, evaluation_queries, model_queries, source_queries]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, first response, dispatch, routing policies and their summary in one plan."""
    return QUERIES["g1_system_summary"](spark, sf)
