"""Bootstrap intervals from counts.

Accuracy, F1 and kappa depend on the data only through a handful of counts: how many rows fall in
each cell (right/wrong, a confusion cell, a label pair). Drawing n rows with replacement is
drawing those counts from a multinomial, so the data is read once and the resampling runs on the
cells. Counts are drawn exactly (conditional binomials), by the same rule at every size; the cost does
not depend on the number of rows. Draws are a function of (seed, group, block of replicates).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from qaloom.operators import agreement, metrics
from qaloom.operators.ranking import join_on, percentiles

BLOCK = 250


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _multinomial(key: pd.Series, counts: pd.Series) -> pd.Series:
    """``BLOCK`` draws of the counts, for each row; the generator is seeded by the key."""

    def draw(name: str, n: np.ndarray) -> list:
        seed = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=16).digest(), "little")
        n = np.asarray(n, np.int64)
        rows = np.random.Generator(np.random.Philox(key=seed)).multinomial(n.sum(), n / n.sum(), size=BLOCK)
        return list(rows)

    return pd.Series([draw(k, n) for k, n in zip(key, counts, strict=True)])


def resampled(cells: DataFrame, by: list[str], cell: list[str], replicates: int, seed: str = "boot") -> DataFrame:
    """Resampled counts: one row per (group, replicate, cell) with ``n`` as DOUBLE.

    ``cells`` has the group keys, the cell keys and a count ``n``. A group's cells are as many as
    its label combinations, so they fit a row. Cells drawn zero times are left out.
    """
    name = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by])
    packed = (
        cells.where(F.col("n") > 0)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct(*cell, F.col("n").cast("bigint").alias("n")))).alias("cells"))
    )
    blocks = F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))
    work = packed.withColumn("__block", F.explode(blocks))
    counts = F.transform("cells", lambda c: c["n"])
    work = work.withColumn("__drawn", _multinomial(F.concat_ws("#", name, F.col("__block")), counts))
    rows = work.select(*by, "cells", "__block", F.posexplode("__drawn").alias("__at", "__n"))
    rows = rows.withColumn("replicate", F.col("__block") * BLOCK + F.col("__at")).where(F.col("replicate") < replicates)
    pairs = F.inline(F.arrays_zip(F.col("cells").alias("c"), F.col("__n").alias("m")))
    rows = rows.select(*by, "replicate", pairs)
    return rows.select(*by, "replicate", *[F.col(f"c.{x}").alias(x) for x in cell], F.col("m").cast("double").alias("n")).where("n > 0")


def interval(replicated: DataFrame, by: list[str], value: str) -> DataFrame:
    """The 2.5 and 97.5 percentiles over replicates; undefined replicates are skipped."""
    return percentiles(replicated, by, value, {"ci_lo": 0.025, "ci_hi": 0.975})


def mean_interval(results: DataFrame, by: list[str], correct: str, replicates: int = 5000, seed: str = "boot", min_n: int = 1) -> DataFrame:
    """Accuracy with its bootstrap interval per group; groups under ``min_n`` are skipped."""
    cells = results.groupBy(*by, F.col(correct).cast("int").alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    again = resampled(cells, by, ["hit"], replicates, seed)
    means = again.groupBy(*by, "replicate").agg((F.sum(F.col("n") * F.col("hit")) / F.sum("n")).alias("m"))
    right = F.sum(F.col("n") * F.col("hit"))
    base = cells.groupBy(*by).agg(F.sum("n").alias("n"), (right / F.sum("n")).alias("accuracy"))
    return join_on(base.where(F.col("n") >= min_n), interval(means, by, "m"), by)


def _f1_replicates(df: DataFrame, by: list[str], truth: str, prediction: str, replicates: int, seed: str) -> DataFrame:
    cells = df.groupBy(*by, F.col(truth).alias("t"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    again = resampled(cells, by, ["t", "p"], replicates, seed)
    return metrics.class_scores_from(again, "t", "p", "n", [*by, "replicate"])


def macro_f1_interval(df: DataFrame, by: list[str], truth: str, prediction: str, replicates: int = 1000, seed: str = "boot") -> DataFrame:
    """Bootstrap interval of macro-F1 per group."""
    again = _f1_replicates(df, by, truth, prediction, replicates, seed)
    again = again.groupBy(*by, "replicate").agg(F.avg("f1").alias("f1"))
    scores = metrics.class_scores(df, truth, prediction, by)
    base = scores.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    lows = interval(again, by, "f1")
    return join_on(base, lows, by) if by else _beside(base, lows)


def class_f1_interval(df: DataFrame, by: list[str], truth: str, prediction: str, replicates: int = 1000, seed: str = "boot") -> DataFrame:
    """Bootstrap interval of each class's F1; replicates without that class are skipped."""
    again = _f1_replicates(df, by, truth, prediction, replicates, seed).where(F.col("support") > 0)
    base = metrics.class_scores(df, truth, prediction, by).where(F.col("support") > 0)
    keys = [*by, "class"]
    return join_on(base.select(*keys, "f1", "support"), interval(again, keys, "f1"), keys)


def kappa_interval(df: DataFrame, a: str, b: str, by: list[str] | None = None, replicates: int = 5000, seed: str = "boot") -> DataFrame:
    """Kappa with its bootstrap interval; replicates with undefined kappa are skipped."""
    by = by or []
    cells = agreement.label_pairs(df, a, b, by)
    again = resampled(cells, by, ["a", "b"], replicates, seed)
    values = agreement.kappa_from(again, [*by, "replicate"])
    base = agreement.kappa_from(cells, by)
    lows = interval(values, by, "kappa")
    return join_on(base, lows, by) if by else _beside(base, lows)


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two one-row results side by side."""
    key = "__one"
    return one.withColumn(key, F.lit(0)).join(other.withColumn(key, F.lit(0)), key).drop(key)

