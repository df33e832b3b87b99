"""Routing policies and their scores; every policy is one CASE over joined columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.rules import literally_extractable
from qaloom.operators.calibration import TAUS, passed, per_threshold
from qaloom.operators.conversations import symbolic_answer
from qaloom.schemas import SYMBOLIC


def with_fallback(predicted: Column, confidence: Column, tau: float, calibrated: bool = True) -> Column:
    """Below the threshold the judge decides; uncalibrated routers never fall back."""
    limit = tau if calibrated else 0.0
    return F.when(confidence < limit, F.lit("SEMANTIC")).otherwise(predicted)


def lookup_answers(df: DataFrame, answers: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Stored answers by content key; in strict (replay) mode a miss is an error."""
    stored = answers.select(
        F.col("cache_key").alias(key), F.struct("answer", "tokens", "latency_ms").alias("__hit")
    )
    joined = df.join(stored, key, "left")
    hit = F.col("__hit")
    if strict:
        message = F.concat(F.lit("no stored answer for "), F.coalesce(F.col(key), F.lit("null")))
        fail = F.raise_error(message).cast("struct<answer:string,tokens:bigint,latency_ms:double>")
        hit = F.when(F.col("__hit").isNotNull(), F.col("__hit")).otherwise(fail)
    return joined.withColumn("__hit", hit).select(
        *df.columns,
        F.col("__hit.answer").alias("judge_answer"),
        F.col("__hit.tokens").alias("judge_tokens"),
        F.col("__hit.latency_ms").alias("judge_latency_ms"),
    )


def routed(predicted: Column, params: Column, judge: Column) -> Column:
    """R2: symbolic routes compute, UNSUPPORTED rejects, the rest takes the judge's answer."""
    return (
        F.when(predicted.isin(SYMBOLIC), symbolic_answer(predicted, params))
        .when(predicted == "UNSUPPORTED", "reject")
        .otherwise(judge)
    )


def routed_strict(predicted: Column, category: Column, params: Column, judge: Column) -> Column:
    """A symbolic route of the wrong kind is not attempted and reads "invalid", as does one that fails."""
    right = predicted.isin(SYMBOLIC) & (predicted == category)
    return (
        F.when(right, F.coalesce(symbolic_answer(category, params, "rescore", "null"), F.lit("invalid")))
        .when(predicted.isin(SYMBOLIC), "invalid")
        .when(predicted == "UNSUPPORTED", "reject")
        .otherwise(judge)
    )


def routed_deployed(predicted: Column, category: Column, prompt: Column, params: Column, judge: Column) -> Column:
    """Computes only what the prompt's own text supports; otherwise, or if that fails, asks the judge."""
    can = literally_extractable(prompt, category, params) & (predicted == category)
    return (
        F.when(predicted.isin(SYMBOLIC) & can, F.coalesce(symbolic_answer(category, params, "rescore", "null"), judge))
        .when(predicted == "UNSUPPORTED", "reject")
        .otherwise(judge)
    )


def unjudged(predicted: Column) -> Column:
    """R2: routes that never ask the judge, and so cost neither tokens nor judge latency."""
    return predicted.isin(*SYMBOLIC, "UNSUPPORTED")


def used_tokens(predicted: Column, tokens: Column) -> Column:
    """R2: only judged rows cost tokens."""
    return F.when(unjudged(predicted), F.lit(0)).otherwise(tokens)


def routing_accuracy(df: DataFrame, router: str, predicted: str, confidence: str, category: str, tau: Column) -> DataFrame:
    """Right, misrouted and fallen-back rows per router, symbolic rows only."""
    final = F.when(F.col(confidence) < tau, F.lit("SEMANTIC")).otherwise(F.col(predicted))
    right = final == F.col(category)
    return (
        df.where(F.col(category).isin(SYMBOLIC))
        .groupBy(router)
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.count_if(right).alias("n_correct"),
            F.count_if(~right).alias("n_misrouted"),
            F.count_if(F.col(confidence) < tau).alias("n_fallback"),
            (F.count_if(right) / F.count(F.lit(1))).alias("accuracy"),
        )
    )


def optimistic_correct(predicted: Column, judge: Column, truth: Column) -> Column:
    """A symbolic route counts as right by construction, even a misrouted one."""
    return (
        F.when(predicted.isin(SYMBOLIC), F.lit(True))
        .when(predicted == "UNSUPPORTED", truth == "reject")
        .otherwise(judge.eqNullSafe(truth))
    )


def tau_sweep(df: DataFrame, router: str, predicted: str, confidence: str, judge: str, truth: str, taus: list[float] | None = None) -> DataFrame:
    """Accuracy, coverage and fallbacks per router and threshold, one pass over the rows.

    A row is reduced to how many thresholds it passes and to whether it is right when routed and
    when judged; each threshold is then a sum over those few counts, not another copy of the data.
    """
    taus = sorted(taus or [0.0, *TAUS])
    by_route = optimistic_correct(F.col(predicted), F.col(judge), F.col(truth))
    by_judge = F.col(judge).eqNullSafe(F.col(truth))
    counts = df.groupBy(router, passed(F.col(confidence), taus).alias("level")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(by_route).alias("by_route"),
        F.count_if(by_judge).alias("by_judge"),
    )
    sums = per_threshold(counts, [router], "level", ["n", "by_route", "by_judge"], taus)
    right = F.col("by_route") + F.col("all_by_judge") - F.col("by_judge")
    return sums.select(
        router,
        "tau",
        (right / F.col("all_n")).alias("accuracy"),
        (F.col("n") / F.col("all_n")).alias("coverage"),
        (F.col("all_n") - F.col("n")).alias("n_fallback"),
    )
