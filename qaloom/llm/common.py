"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.session import shared_folder

# Bytes of [0-9a-z] and of every non-ASCII character stay, A-Z is lowered, all else becomes a space.
_WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
_LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BATCH_ROWS = 1024
TEXTS = 128  # texts of a batch that are Python objects at once


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the one all executors share; no two runs collide."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes the rows once and reads them back: cuts lineage, and survives a lost executor."""
    folder = new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def words(text: bytes) -> list[bytes]:
    """A-Z lowered, then the runs of digits, a-z and non-ASCII characters, as UTF-8."""
    return text.translate(_WORD_BYTES).split()


def spaced_words(text: bytes) -> list[bytes]:
    """A-Z lowered, then what stands between ASCII white space, as UTF-8."""
    return text.translate(_LOWER_BYTES).split()


def texts(batch: pa.RecordBatch) -> list[str]:
    """The whole texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def utf8(batch: pa.RecordBatch) -> list[bytes]:
    """The whole texts of a batch as UTF-8; null reads as empty."""
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _short_batches(spark: SparkSession) -> None:
    """Rows are whole texts, so the session's Arrow batches, which Spark bounds by rows, get at most ``BATCH_ROWS`` of them."""
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs inside."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow``: batches in, batches out, inside the tasks that read the rows."""
    _short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        # Workers live on: what their batches took is given back.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that further columns, whatever their names, are not read."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_filter(docs: DataFrame, accepts: Callable[[], Callable[[list[bytes]], list[bool]]]) -> DataFrame:
    """The documents, with all their columns, whose text is accepted; the text alone goes through Python.

    ``accepts`` makes, once in a task, the function from some texts (UTF-8, null as empty) to what is accepted.
    """

    _short_batches(docs.sparkSession)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decide = accepts()
        for part in parts:
            found: list[bool] = []
            for at in range(0, len(part), TEXTS):
                found += decide([t or b"" for t in part.slice(at, TEXTS).cast(pa.binary()).to_pylist()])
            yield pa.array(found, pa.bool_())

    return docs.filter(F.arrow_udf(run, "boolean")(F.col("text").cast("string")))
