"""Validation gates: every gate returns its violations (rule, key, detail); empty means passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import rules


def _violations(df: DataFrame, rule: str, key, detail: Column) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(rule).alias("rule"), k.cast("string").alias("key"), detail.cast("string").alias("detail"))


def category_counts(df: DataFrame, category: str, expected: dict[str, int]) -> DataFrame:
    """V1: categories whose row count is not the expected one, unexpected categories included."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(expected.items()), "category string, expected bigint")
    seen = df.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    both = seen.join(table, "category", "full")
    wrong = both.where(F.coalesce("n", F.lit(0)) != F.coalesce("expected", F.lit(0)))
    detail = F.format_string("expected %s, found %s", F.coalesce("expected", F.lit(0)).cast("string"), F.coalesce("n", F.lit(0)).cast("string"))
    return _violations(wrong, "V1_category_count", "category", detail)


def unique_and_complete(df: DataFrame, key: str, truth: str) -> DataFrame:
    """V2: keys that occur more than once, and rows without a stored answer."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return _violations(twice, "V2_duplicate_key", key, F.col("n")).unionByName(
        _violations(df.where(F.col(truth).isNull()), "V2_missing_truth", key, F.lit("null"))
    )


def operators_agree(df: DataFrame, key: str, category: str, prompt: str, params: str) -> DataFrame:
    """V3: TIME and COUNT rows without an operator, without usable wording, or where they differ."""
    rows = df.where(F.col(category).isin("SYMBOLIC_TIME", "SYMBOLIC_COUNT"))
    op = F.get_json_object(F.col(params), "$.operator")
    tag = rules.polarity(F.col(prompt), F.col(params))
    checked = rows.select(key, op.alias("op"), tag.alias("tag"))
    rule = (
        F.when(F.col("op").isNull(), "V3_missing_operator")
        .when(F.col("tag.polarity").isNull(), "V3_not_parseable")
        .when(~F.col("tag.polarity").eqNullSafe(rules.operator_polarity(F.col("op"))), "V3_polarity_differs")
    )
    found = checked.withColumn("rule", rule).where(F.col("rule").isNotNull())
    detail = F.concat_ws(" ", F.coalesce("op", F.lit("none")), F.col("tag.reason"))
    return found.select("rule", F.col(key).cast("string").alias("key"), detail.alias("detail"))


def answers_agree(df: DataFrame, key: str, stored: str, recomputed: dict[str, str]) -> DataFrame:
    """V4: rows where a recomputed answer is not the stored one; one entry per method name."""
    out = None
    for name, column in recomputed.items():
        wrong = df.where(~F.col(stored).eqNullSafe(F.col(column)))
        detail = F.concat_ws(" != ", F.coalesce(column, F.lit("null")), F.coalesce(stored, F.lit("null")))
        part = _violations(wrong, f"V4_{name}", key, detail)
        out = part if out is None else out.unionByName(part)
    return out


def rule_counts(*gates: DataFrame) -> DataFrame:
    """V6: violations per rule over several gates; no row means that rule passed."""
    every = gates[0]
    for g in gates[1:]:
        every = every.unionByName(g)
    return every.groupBy("rule").agg(F.count(F.lit(1)).alias("n_violations"))


def summary_document(df: DataFrame, **facts: Column) -> DataFrame:
    """V6: named facts about a table as one row, ready to be written as one JSON document."""
    return df.agg(*[c.alias(n) for n, c in facts.items()])
