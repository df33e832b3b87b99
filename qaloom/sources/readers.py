"""Typed readers for the CSV, JSON and Parquet inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",", multi_line: bool = True) -> DataFrame:
    """A1/A3: header CSV with a declared schema; quotes and commas inside fields, and line breaks too.

    With ``multi_line`` a file is one task; without, large files are split, and no field may hold a line break.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("sep", separator)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def sniff_separator(spark: SparkSession, path: str) -> str:
    """A2: the most frequent of comma, semicolon, tab and bar in the header line."""
    line = spark.read.text(path).limit(1).first()
    header = line[0] if line else ""
    return max([",", ";", "\t", "|"], key=header.count)


def read_csv_any(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """A2: header CSV whose separator is not known."""
    return read_csv(spark, path, schema, sniff_separator(spark, path), multi_line)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A5: JSON documents, one per file, as rows."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {key: {answer, tokens, ...}} as the answer table, one row per key."""
    value = "struct<answer:string,tokens:bigint,raw:string,latency_ms:double>"
    text = spark.read.option("wholetext", True).text(path)
    parsed = F.from_json("value", f"map<string,{value}>")
    return text.select(F.explode(parsed).alias("cache_key", "v")).select("cache_key", "v.*")


def read_latest(spark: SparkSession, path: str, column: str = "snapshot") -> DataFrame:
    """A10: the newest snapshot of a table partitioned by snapshot; only its files are read."""
    table = spark.read.parquet(path)
    newest = table.select(F.max(column)).first()[0]
    return table.where(F.col(column) == newest)


def fingerprint(df: DataFrame, column: str) -> DataFrame:
    """An 8-hex-digit fingerprint of a column's values as a multiset.

    The four 32-bit quarters of each value's md5 are summed, so the result depends neither on row
    order nor on partitioning, repeats count, and nothing is collected.
    """
    digest = F.md5(F.col(column))
    quarters = [
        F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(4)
    ]
    joined = F.concat_ws(":", F.count(column).cast("string"), *quarters)
    return df.agg(F.substring(F.md5(joined), 1, 8).alias("fingerprint"))
