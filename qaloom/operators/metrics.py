"""Accuracy, confusion, F1, latency, cross-tabs and listings over long result tables.

Every function is one or two mergeable aggregates over low-cardinality keys, so the input is read
once and only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.operators.ranking import join_on, percentiles


def to_long(df: DataFrame, keep: list[str], systems: list[str], suffix: str = "_correct") -> DataFrame:
    """One row per (row, system) from one flag column per system; no shuffle."""
    flags = F.array(
        *[F.struct(F.lit(s).alias("system"), F.col(f"{s}{suffix}").alias("correct")) for s in systems]
    )
    return df.select(*keep, F.explode(flags).alias("__s")).select(*keep, "__s.*")


def system_summary(
    results: DataFrame, system: str = "system", correct: str = "correct", tokens: str = "tokens", latency: str = "latency_ms"
) -> DataFrame:
    """G1: accuracy, n, token sum and latency mean/p50/p95 per system."""
    sums = results.groupBy(system).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(correct).alias("accuracy"),
        F.sum(tokens).alias("total_tokens"),
        F.avg(latency).alias("mean_latency_ms"),
    )
    middle = percentiles(results, [system], latency, {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    return join_on(sums, middle, [system], "left")


def latency_profile(results: DataFrame, by: list[str], latency: str = "latency_ms") -> DataFrame:
    """Mean, p50, p95, p99, min and max of stored latencies."""
    sums = results.groupBy(*by).agg(
        F.count(latency).alias("n"),
        F.avg(latency).alias("mean"),
        F.min(latency).alias("min"),
        F.max(latency).alias("max"),
    )
    return join_on(sums, percentiles(results, by, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), by, "left")


def aligned(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two result files joined on their key; a key that only one side has is an error."""
    a = first.withColumn("__a", F.lit(True))
    b = second.withColumn("__b", F.lit(True))
    joined = a.join(b, key, "full")
    message = F.concat(F.lit("row in one table only: "), F.col(key).cast("string"))
    both = F.when(F.col("__a") & F.col("__b"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return joined.where(both).drop("__a", "__b")


def accuracy_by(results: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """G3/G13/G21/G24 in long form: n and mean correctness per group."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(correct).alias("accuracy"))


def accuracy_table(df: DataFrame, category: str, systems: list[str], suffix: str = "_correct") -> DataFrame:
    """G3 in wide form: one row per category, one accuracy column per system."""
    return df.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"{s}{suffix}").alias(s) for s in systems]
    )


def accuracy_by_source(df: DataFrame, source: str, systems: list[str], suffix: str = "_correct") -> DataFrame:
    """Accuracy per truth source and over all rows, in one pass."""
    rolled = df.rollup(source).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"{s}{suffix}").alias(s) for s in systems]
    )
    return rolled.withColumn(source, F.coalesce(F.col(source), F.lit("ALL")))


def answerable_accuracy(df: DataFrame, category: str, systems: list[str], suffix: str = "_correct") -> DataFrame:
    """Accuracy over everything and over what can be answered at all, per system."""
    can = F.col(category) != "UNSUPPORTED"
    facts = [F.count(F.lit(1)).alias("n"), F.count_if(can).alias("n_answerable")]
    for s in systems:
        c = F.col(f"{s}{suffix}")
        facts += [F.avg(c).alias(f"all_{s}"), F.avg(F.when(can, c)).alias(f"answerable_{s}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("system"),
                F.col(f"all_{s}").alias("accuracy"),
                F.col(f"answerable_{s}").alias("answerable_accuracy"),
            )
            for s in systems
        ]
    )
    return df.agg(*facts).select("n", "n_answerable", F.explode(rows).alias("r")).select(
        "r.system", "n", "n_answerable", "r.accuracy", "r.answerable_accuracy"
    )


def class_balance(df: DataFrame, category: str) -> DataFrame:
    """Count, share and ratio to the smallest class, with the overall max/min imbalance."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    return counts.select(
        category,
        "n",
        (F.col("n") / F.sum("n").over(whole)).alias("share"),
        (F.col("n") / F.min("n").over(whole)).alias("ratio_to_smallest"),
        (F.max("n").over(whole) / F.min("n").over(whole)).alias("imbalance"),
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Counts of two keys, absent combinations as 0; the column values are given."""
    return df.groupBy(rows).agg(
        *[F.count_if(F.col(columns) == v).alias(str(v)) for v in values]
    )


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Long confusion counts with the share of the true class's row."""
    counts = df.groupBy(truth, prediction).agg(F.count(F.lit(1)).alias("n"))
    row = Window.partitionBy(truth)  # at most one row per predicted class
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(row))


def class_scores_from(counts: DataFrame, truth: str, prediction: str, n: str, by: list[str]) -> DataFrame:
    """Per-class precision, recall, F1 and support from (possibly weighted) confusion counts.

    Classes are those seen in truth or prediction; an undefined score is 0.
    """
    both = F.array(
        F.struct(
            F.col(truth).alias("class"),
            F.col(n).alias("support"),
            F.lit(0).cast("double").alias("predicted"),
            F.when(F.col(truth) == F.col(prediction), F.col(n)).otherwise(0).alias("tp"),
        ),
        F.struct(
            F.col(prediction).alias("class"),
            F.lit(0).cast("double").alias("support"),
            F.col(n).alias("predicted"),
            F.lit(0).cast("double").alias("tp"),
        ),
    )
    parts = counts.select(*by, F.explode(both).alias("__p")).select(*by, "__p.*")
    sums = parts.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    tp = F.col("tp")
    return sums.select(
        *by,
        "class",
        ratio(tp, F.col("predicted")).alias("precision"),
        ratio(tp, F.col("support")).alias("recall"),
        ratio(2 * tp, F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def class_scores(df: DataFrame, truth: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """Per-class precision, recall, F1 and support."""
    by = by or []
    counts = df.groupBy(*by, truth, prediction).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return class_scores_from(counts, truth, prediction, "n", by)


def overall_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and support-weighted averages of per-class scores."""
    weight = F.col("support") / F.sum("support").over(Window.partitionBy(*(by or [F.lit(0)])))
    named = scores.withColumn("__w", weight)
    return named.groupBy(*(by or [])).agg(
        F.sum("support").cast("bigint").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.sum(F.col("__w") * F.col("f1")).alias("weighted_f1"),
    )


def confusion_pairs(df: DataFrame, truth: str, prediction: str, key: str, text: str, examples: int = 3) -> DataFrame:
    """Misclassified pairs by size, with the first few texts in key order.

    The examples come from a window that keeps ``examples`` rows per pair before the shuffle.
    """
    wrong = df.where(F.col(truth) != F.col(prediction))
    sizes = wrong.groupBy(truth, prediction).agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy(truth, prediction).orderBy(key)
    shown = (
        wrong.select(truth, prediction, key, text)
        .withColumn("__r", F.row_number().over(window))
        .where(F.col("__r") <= examples)
        .groupBy(truth, prediction)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", text))), lambda s: s[text]).alias("examples"))
    )
    return join_on(sizes, shown, [truth, prediction]).orderBy(F.desc("n"), truth, prediction)


def generalisation_gap(test: DataFrame, holdout: DataFrame, model: str, score: str = "macro_f1") -> DataFrame:
    """Test score minus holdout score per model."""
    h = holdout.select(model, F.col(score).alias("holdout"))
    return test.select(model, F.col(score).alias("test")).join(h, model).withColumn(
        "gap", F.col("test") - F.col("holdout")
    )


def best_per(df: DataFrame, by: list[str], name: str, score: str) -> DataFrame:
    """The arg-max of a score, ties to the smaller name; a mergeable aggregate."""
    best = F.max(F.struct(F.col(score).alias("s"))).alias("__best")
    top = df.groupBy(*by).agg(best) if by else df.agg(best)
    joined = join_on(df, top, by) if by else df.join(F.broadcast(top), F.col(score) == F.col("__best.s"))
    hit = joined.where(F.col(score) == F.col("__best.s"))
    return hit.groupBy(*by).agg(F.min(name).alias(name), F.max(score).alias(score))


def top_models(scores: DataFrame, model: str, score: str, k: int = 2) -> DataFrame:
    """The k best models."""
    return scores.orderBy(F.desc(score), model).limit(k)


def error_listing(df: DataFrame, key: str, ok: str, truth: str, prediction: str) -> DataFrame:
    """Rows that failed and rows that were misrouted, each with its error type."""
    failed = df.where(~F.col(ok)).select(
        key, F.lit("wrong_answer").alias("error_type"), truth, prediction
    )
    misrouted = df.where(F.col(truth) != F.col(prediction)).select(
        key, F.lit("misroute").alias("error_type"), truth, prediction
    )
    return failed.unionByName(misrouted)


def tool_sweep(results: DataFrame, model: str, by: str, calls: Column, valid: list[str]) -> DataFrame:
    """Per model accuracy, tokens and calls per prompt, invalid count and p50/p95 latency."""
    sums = results.groupBy(model).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("correct").alias("accuracy"),
        F.avg("tokens").alias("tokens_per_prompt"),
        F.avg(calls).alias("calls_per_prompt"),
        F.count_if(F.col("answer").isNull()).alias("n_errors"),
        F.count_if(~F.col("answer").isin(*valid)).alias("n_invalid"),
    )
    timed = percentiles(results, [model], "latency_ms", {"p50": 0.5, "p95": 0.95})
    wide = join_on(sums, timed, [model], "left")
    parts = results.groupBy(model, by).agg(F.avg("correct").alias("a"))
    parts = parts.groupBy(model).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, "a")))).alias("accuracy_by")
    )
    return join_on(wide, parts, [model], "left")
