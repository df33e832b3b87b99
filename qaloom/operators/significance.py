"""Paired and two-sample tests: one aggregate over the data, the formula on its few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions import tails
from qaloom.functions.text import stars
from qaloom.operators.ranking import join_on
from qaloom.session import lookup


def mcnemar_statistic(b: Column, c: Column) -> Column:
    """Continuity-corrected chi-square of the discordant counts; 0 when there are none."""
    n = b + c
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(F.abs(b - c) - 1, F.lit(2.0)) / n)


def cohens_h(p1: Column, p2: Column) -> Column:
    """S3: difference of arcsine-transformed proportions, clamped to [.001, .999]."""

    def angle(p: Column) -> Column:
        return 2 * F.asin(F.sqrt(F.greatest(F.lit(0.001), F.least(F.lit(0.999), p))))

    return angle(p2) - angle(p1)


def holm(df: DataFrame, p: str, by: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """Adds ``p_holm``; one row per test, so the window covers a statistics table, not data."""
    by = by or [F.lit(0)]
    order = [F.col(p), *[F.col(t) for t in tie or []]]
    inner = Window.partitionBy(*by).orderBy(*order)
    step = F.col(p) * (F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(inner) + 1)
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    capped = df.withColumn("__step", F.least(F.lit(1.0), step))
    return capped.withColumn("p_holm", F.max("__step").over(running)).drop("__step")


def mcnemar_table(df: DataFrame, baselines: list[str], routers: list[str], suffix: str = "_correct") -> DataFrame:
    """Every baseline against every router from one wide row per item, in a single aggregate.

    Adds p, Cohen's h, and Holm's correction of the 6-decimal p, as published tables do.
    """
    facts = [F.avg(f"{s}{suffix}").alias(f"acc_{s}") for s in {*baselines, *routers}]
    rows = []
    for x in baselines:
        for y in routers:
            left, right = F.col(f"{x}{suffix}"), F.col(f"{y}{suffix}")
            facts += [
                F.count_if((left == 0) & (right == 1)).alias(f"b_{x}_{y}"),
                F.count_if((left == 1) & (right == 0)).alias(f"c_{x}_{y}"),
            ]
            rows.append(
                F.struct(
                    F.lit(x).alias("baseline"),
                    F.lit(y).alias("router"),
                    F.col(f"b_{x}_{y}").alias("b"),
                    F.col(f"c_{x}_{y}").alias("c"),
                    cohens_h(F.col(f"acc_{x}"), F.col(f"acc_{y}")).alias("cohens_h"),
                )
            )
    table = df.agg(*facts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    table = table.withColumn("chi2", mcnemar_statistic(F.col("b"), F.col("c")))
    table = table.withColumn("p_value", F.round(tails.chi2_tail_1(F.col("chi2")), 6))
    table = holm(table, "p_value", tie=["baseline", "router"])
    return table.withColumns(
        {
            "significant": F.col("p_value") < 0.05,
            "significant_holm": F.col("p_holm") < 0.05,
            "stars": stars(F.col("p_holm")),
        }
    )


def chi2_independence(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Chi-square statistic and degrees of freedom of a two-key table.

    As in the usual library routine, a 2 x 2 table gets the continuity correction.
    """
    counts = df.groupBy(rows, columns).agg(F.count(F.lit(1)).alias("n"))
    r, c, whole = Window.partitionBy(rows), Window.partitionBy(columns), Window.partitionBy(F.lit(0))
    cells = counts.select(
        "n",
        F.sum("n").over(r).alias("row_n"),
        F.sum("n").over(c).alias("col_n"),
        F.sum("n").over(whole).alias("total"),
        F.size(F.collect_set(rows).over(whole)).alias("n_rows"),
        F.size(F.collect_set(columns).over(whole)).alias("n_cols"),
    )
    # A cell with no rows adds its whole expectation. The expectations of all cells sum to the
    # total, so what the present cells leave of it belongs to the absent ones (dof > 1; in a
    # 2 x 2 table an absent cell adds the same shrunk gap as the present ones).
    n, total = F.col("n"), F.col("total")
    expected = F.col("row_n") * F.col("col_n") / total
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    gap = F.abs(n - expected)
    shrunk = gap - F.least(gap, F.lit(0.5))
    sums = cells.groupBy("total", dof.alias("dof")).agg(
        F.sum(gap * gap / expected).alias("plain"),
        F.max(shrunk).alias("shrunk"),
        F.sum(expected).alias("seen"),
        F.first(
            F.struct(
                F.col("row_n").alias("r"), F.col("col_n").alias("c"), total.alias("t")
            )
        ).alias("m"),
    )
    r1, c1 = F.col("m.r"), F.col("m.c")
    r2, c2 = total - r1, total - c1
    inverse = total / (r1 * c1) + total / (r1 * c2) + total / (r2 * c1) + total / (r2 * c2)
    corrected = F.col("shrunk") * F.col("shrunk") * inverse
    chi2 = F.when(F.col("dof") == 1, corrected).otherwise(F.col("plain") + total - F.col("seen"))
    return sums.select("total", "dof", chi2.alias("chi2")).withColumn(
        "p_value", tails.chi2_upper(F.col("chi2"), F.col("dof").cast("double"))
    )


def two_sample(df: DataFrame, flag: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Pooled-variance t statistic, degrees of freedom and Cohen's d of flag=1 vs flag=0."""
    by = by or []

    def facts(side: int) -> list[Column]:
        v = F.when(F.col(flag) == side, F.col(value).cast("double"))
        return [
            F.count(v).alias(f"n{side}"),
            F.avg(v).alias(f"mean{side}"),
            F.var_samp(v).alias(f"var{side}"),
        ]

    sums = df.groupBy(*by).agg(*facts(1), *facts(0)) if by else df.agg(*facts(1), *facts(0))
    n1, n0 = F.col("n1"), F.col("n0")
    dof = n1 + n0 - 2
    pooled = ((n1 - 1) * F.col("var1") + (n0 - 1) * F.col("var0")) / dof
    gap = F.col("mean1") - F.col("mean0")
    usable = (n1 > 1) & (n0 > 1) & (pooled > 0)
    return sums.select(
        *by,
        "n1",
        "n0",
        "mean1",
        "mean0",
        dof.alias("dof"),
        F.when(usable, gap / F.sqrt(pooled * (1 / n1 + 1 / n0))).alias("t"),
        F.when(usable, gap / F.sqrt(pooled)).alias("cohens_d"),
    )


def with_t_p_value(table: DataFrame) -> DataFrame:
    """Two-sided p-value of the ``t`` and ``dof`` columns of a small table."""
    return table.withColumn("p_value", tails.t_two_sided(F.col("t"), F.col("dof").cast("double")))


def length_adjusted(df: DataFrame, flag: str, value: str, length: str, by: list[str] | None = None) -> DataFrame:
    """The two-sample test on residuals of a straight-line fit of value on length."""
    keys = by or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    fit = rows.groupBy(*keys).agg(
        F.regr_slope(F.col(value), F.col(length)).alias("__slope"),
        F.regr_intercept(F.col(value), F.col(length)).alias("__start"),
    )
    joined = join_on(rows, lookup(fit), keys)
    rest = F.col(value) - (F.col("__slope") * F.col(length) + F.col("__start"))
    return two_sample(joined.withColumn("__residual", rest), flag, "__residual", by)


def t_interval(df: DataFrame, by: list[str], run: str, correct: str) -> DataFrame:
    """95% t-interval of run-level means; a zero spread is reported as exact."""
    runs = df.groupBy(*by, run).agg(F.avg(correct).alias("a"))
    sums = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("a").alias("mean"), F.stddev_samp("a").alias("std")
    )
    n = F.col("n_runs")
    kind = (
        F.when(n < 2, "single run").when(F.col("std") > 0, "interval").otherwise("zero variance")
    )
    half = tails.t_quantile_95((n - 1).cast("double")) * F.col("std") / F.sqrt(n)
    return sums.withColumn("kind", kind).withColumn("__half", half).select(
        *by,
        "n_runs",
        "mean",
        "std",
        "kind",
        F.when(F.col("kind") == "interval", F.col("mean") - F.col("__half")).alias("low"),
        F.when(F.col("kind") == "interval", F.col("mean") + F.col("__half")).alias("high"),
    )
