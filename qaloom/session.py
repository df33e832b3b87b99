"""Session settings and the few places where lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest aggregate that may be broadcast, in rows and in measured bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: str = "*", app: str = "qaloom", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="qaloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What queries made and run inside have shuffled is deleted as each of them ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def lookup(df: DataFrame, max_rows: int = BROADCAST_ROWS, row_bytes: int = 64) -> DataFrame:
    """Materialise an aggregate that is joined back to its input, and broadcast it only if small.

    The aggregate is checkpointed first, and its rows and bytes are measured (as JSON, plus ``row_bytes``
    for a row's own overhead and its fixed-width values). Up to ``max_rows`` rows and ``BROADCAST_BYTES`` bytes it is marked for broadcast, so the big side is
    not shuffled; beyond that it is left to a shuffled join, where adaptive execution splits hot keys.
    """
    done = checkpoint(df)
    length = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    rows, size = done.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(length)).first()
    return F.broadcast(done) if rows <= max_rows and (size or 0) + rows * row_bytes <= BROADCAST_BYTES else done
