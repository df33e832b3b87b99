"""Column layouts of the tables this library reads and writes, as DDL text."""

from __future__ import annotations

from pyspark.sql import DataFrame

PROMPT = (
    "prompt STRING, category STRING, subcategory STRING, style STRING, noise STRING, "
    "params STRING, top_category STRING"
)
PARAMS = "threshold DOUBLE, unit STRING, operator STRING, subtype STRING, value STRING"
MESSAGE = "role STRING, text STRING, timestamp STRING, is_public BOOLEAN, channel STRING"
CONVERSATION = (
    "messages ARRAY<STRUCT<role: STRING, text: STRING, timestamp: STRING, is_public: BOOLEAN, "
    "channel: STRING>>, tags ARRAY<STRING>, channel STRING, resolution_time_minutes DOUBLE"
)
PAIR = (
    "prompt STRING, category STRING, conversation_json STRING, conversation_idx BIGINT, "
    "ground_truth STRING, ground_truth_source STRING, scenario STRING, params STRING, "
    "actual_response_time_min DOUBLE, actual_count BIGINT"
)
SYSTEM_RESULT = (
    "idx BIGINT, router STRING, prompt STRING, predicted_category STRING, true_category STRING, "
    "answer STRING, ground_truth STRING, correct INT, tokens BIGINT, latency_ms DOUBLE"
)
REPEAT_RUN = (
    "model STRING, run INT, idx BIGINT, category STRING, prompt STRING, answer STRING, "
    "ground_truth STRING, correct INT, prompt_tokens BIGINT, completion_tokens BIGINT, "
    "reasoning_tokens BIGINT, total_tokens BIGINT, latency_ms DOUBLE"
)
ANNOTATION = (
    "id BIGINT, prompt STRING, annotator_category STRING, annotator_confidence STRING, notes STRING"
)
ANNOTATION_KEY = (
    "id BIGINT, prompt STRING, true_category STRING, fine_category STRING, generation_method STRING"
)
HOLDOUT = "prompt STRING, top_category STRING, generation_source STRING"
EMBEDDING = "id BIGINT, embedding ARRAY<FLOAT>"
ANSWER = "cache_key STRING, answer STRING, tokens BIGINT, raw STRING, latency_ms DOUBLE"

# Routing classes, in the order probability arrays use.
CLASSES = [
    "HYBRID",
    "SEMANTIC",
    "SYMBOLIC_COUNT",
    "SYMBOLIC_METADATA",
    "SYMBOLIC_TIME",
    "UNSUPPORTED",
]
SYMBOLIC = ["SYMBOLIC_TIME", "SYMBOLIC_COUNT", "SYMBOLIC_METADATA"]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """V7, the schema half: fail before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; have {df.columns}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """V7, the data half: fail when nothing is left to analyse (reads at most one row)."""
    if df.isEmpty():
        raise ValueError("no rows left to analyse")
    return df
