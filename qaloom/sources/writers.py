"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    """A4: header CSV that ``read_csv`` reads back unchanged."""
    writer = df.write.mode("overwrite").option("header", True).option("sep", separator)
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("quote", '"').option("escape", '"').csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """A5: each row as one JSON document per line (one row, one document)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_snapshot(df: DataFrame, path: str, snapshot: str, by: list[str] | None = None) -> None:
    """A4/A10: Parquet under snapshot=...; earlier snapshots stay."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/snapshot={snapshot}")


def write_embeddings(df: DataFrame, path: str, key: str, vector: str) -> None:
    """The embedding store: key and vector, nothing positional."""
    df.select(key, vector).write.mode("overwrite").parquet(path)
