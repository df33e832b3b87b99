"""Variance, wins and error overlap over repeated runs of several models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.operators.ranking import join_on, percentiles


def answer_counts(runs: DataFrame, by: list[str], answer: str, correct: str) -> DataFrame:
    """G11, first stage: distinct answers, correct runs and runs per item.

    Runs are collapsed to one row per answer first, so an item with very many runs is counted
    where it is read.
    """
    per_answer = runs.groupBy(*by, answer).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.col(correct).cast("bigint")).alias("__c")
    )
    return per_answer.groupBy(*by).agg(
        F.count(answer).alias("unique_answers"),
        F.sum("__c").alias("correct_runs"),
        F.sum("__n").alias("total_runs"),
    )


def inconsistency(items: DataFrame, by: list[str]) -> DataFrame:
    """G11, second stage: share of items with more than one answer, and mean correctness."""
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("unique_answers") > 1).alias("n_inconsistent"),
        (F.count_if(F.col("unique_answers") > 1) / F.count(F.lit(1))).alias("inconsistent_share"),
        (F.sum("correct_runs") / F.sum("total_runs")).alias("accuracy"),
    )


def run_statistics(
    runs: DataFrame, model: str, run: str, item: str, answer: str, correct: str, tokens: str, latency: str
) -> DataFrame:
    """Mean and spread of per-run accuracy, inconsistent items, tokens and latency per model."""
    per_run = (
        runs.groupBy(model, run)
        .agg(F.avg(correct).alias("a"))
        .groupBy(model)
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.avg("a").alias("mean_accuracy"),
            F.stddev_samp("a").alias("std_accuracy"),
        )
    )
    items = inconsistency(answer_counts(runs, [model, item], answer, correct), [model])
    sums = runs.groupBy(model).agg(
        F.avg(tokens).alias("mean_tokens"), F.avg(latency).alias("mean_latency")
    )
    timed = percentiles(runs, [model], latency, {"p50": 0.5, "p95": 0.95})
    out = join_on(per_run, items.select(model, "n_items", "n_inconsistent"), [model])
    return join_on(join_on(out, sums, [model]), timed, [model], "left")


def item_accuracy(runs: DataFrame, keys: list[str], model: str, models: list[str], correct: str) -> DataFrame:
    """Mean correctness per item, one column per model (null where a model never ran)."""
    return runs.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(model) == m, F.col(correct))).alias(m) for m in models]
    )


def win_lose(items: DataFrame, first: str, second: str, models: list[str], high=0.8, low=0.2) -> DataFrame:
    """Adds the verdicts first_wins, second_wins, all_wrong and all_right per item."""

    def every(test) -> Column:
        out = F.lit(True)
        for m in models:
            out = out & test(F.col(m))
        return F.coalesce(out, F.lit(False))

    def beats(a: str, b: str):
        return F.coalesce((F.col(a) >= high) & (F.col(b) <= low), F.lit(False))

    return items.withColumns(
        {
            "first_wins": beats(first, second),
            "second_wins": beats(second, first),
            "all_wrong": every(lambda c: c <= low),
            "all_right": every(lambda c: c >= high),
        }
    )


def majority_wrong(items: DataFrame, models: list[str]) -> DataFrame:
    """One boolean per model, true where under half of the runs were correct."""
    return items.withColumns({m: F.col(m) < 0.5 for m in models})


def error_overlap(wrong: DataFrame, models: list[str]) -> DataFrame:
    """Shared and total errors and their Jaccard for every pair of models, one aggregate."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    facts = []
    for a, b in pairs:
        facts += [
            F.count_if(F.col(a) & F.col(b)).alias(f"{a}&{b}"),
            F.count_if(F.col(a) | F.col(b)).alias(f"{a}|{b}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("model_a"),
                F.lit(b).alias("model_b"),
                F.col(f"`{a}&{b}`").alias("shared"),
                F.col(f"`{a}|{b}`").alias("total"),
            )
            for a, b in pairs
        ]
    )
    long = wrong.agg(*facts).select(F.explode(rows).alias("r")).select("r.*")
    return long.withColumn("jaccard", F.when(F.col("total") > 0, F.col("shared") / F.col("total")))


def error_sets(wrong: DataFrame, models: list[str]) -> DataFrame:
    """Per model the majority-wrong and uniquely solved items, and the errors all share."""

    def all_of(names: list[str]):
        out = F.lit(True)
        for m in names:
            out = out & F.coalesce(F.col(m), F.lit(False))
        return out

    facts = [F.count_if(all_of(models)).alias("universal")]
    for m in models:
        others = all_of([o for o in models if o != m])
        facts += [
            F.count_if(F.col(m)).alias(f"{m}_wrong"),
            F.count_if(~F.col(m) & others).alias(f"{m}_only"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.col(f"`{m}_wrong`").alias("n_wrong"),
                F.col(f"`{m}_only`").alias("n_uniquely_solved"),
            )
            for m in models
        ]
    )
    return wrong.agg(*facts).select("universal", F.explode(rows).alias("r")).select("r.*", "universal")


def inconsistent_by_category(
    runs: DataFrame, model: str, item: str, category: str, answer: str, valid: list[str]
) -> DataFrame:
    """Items with more than one distinct valid answer, counted per model and category."""
    answers = runs.where(F.col(answer).isin(*valid)).groupBy(model, item, answer).agg(
        F.min(category).alias(category)
    )
    items = answers.groupBy(model, item).agg(
        F.count(F.lit(1)).alias("n"), F.min(category).alias(category)
    )
    return items.where(F.col("n") > 1).groupBy(model, category).agg(F.count(F.lit(1)).alias("n_inconsistent"))


# USD per million tokens, input and output.
PRICES = {
    "o3-mini": (1.10, 4.40),
    "o1": (15.00, 60.00),
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
}


def cost(
    runs: DataFrame, model: str, tokens_in: str, tokens_out: str, prices: dict | None = None, per_day: int = 30_000
) -> DataFrame:
    """Mean cost per evaluation and per day; models without a price are left out."""
    prices = prices or PRICES
    price = F.create_map(
        *[
            x
            for m, (i, o) in prices.items()
            for x in (F.lit(m), F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")))
        ]
    )
    means = (
        runs.where(F.col(model).isin(*prices))
        .groupBy(model)
        .agg(F.avg(tokens_in).alias("mean_in"), F.avg(tokens_out).alias("mean_out"))
    )
    rate = price[F.col(model)]
    each = F.col("mean_in") / 1e6 * rate["i"] + F.col("mean_out") / 1e6 * rate["o"]
    return means.withColumn("cost_each", each).withColumn("cost_daily", F.col("cost_each") * per_day)
