"""Agreement of two raters, from the counts of their label pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import acceptance_band, clean_label, kappa_band
from qaloom.operators.ranking import join_on


def paired_labels(first: DataFrame, second: DataFrame, key: str, label: str, valid: list[str] | None = None, case: str = "upper") -> DataFrame:
    """(key, a, b) joined on the key, never by position; blank labels are dropped."""
    a = first.select(key, clean_label(F.col(label), case).alias("a"))
    b = second.select(key, clean_label(F.col(label), case).alias("b"))
    both = a.join(b, key).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return both if valid is None else both.where(F.col("a").isin(valid) & F.col("b").isin(valid))


def join_answer_key(df: DataFrame, answers: DataFrame, preferred: str, fallback: str) -> DataFrame:
    """Join on the preferred key if both tables have it, else on the fallback key."""
    use = preferred if preferred in df.columns and preferred in answers.columns else fallback
    extra = [c for c in answers.columns if c == use or c not in df.columns]
    return df.join(answers.select(*extra), use)


def label_pairs(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Counts of label pairs per group: all that any agreement measure needs."""
    return df.groupBy(*(by or []), F.col(a).alias("a"), F.col(b).alias("b")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )


def kappa_from(pairs: DataFrame, by: list[str]) -> DataFrame:
    """S8 from (possibly resampled) label-pair counts: n, agreement, expected agreement, kappa."""
    group = Window.partitionBy(*(by or [F.lit(0)]))
    sides = F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0.0).alias("nb")),
        F.struct(F.col("b").alias("label"), F.lit(0.0).alias("na"), F.col("n").alias("nb")),
    )
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)
    labels = (
        pairs.select(*by, same.alias("same"), F.explode(sides).alias("s"))
        .groupBy(*by, "s.label")
        .agg(
            # Each pair row is exploded twice; halving keeps the diagonal count right.
            (F.sum("same") / 2).alias("same"),
            F.sum("s.na").alias("na"),
            F.sum("s.nb").alias("nb"),
        )
    )
    n = F.sum("na").over(group)
    return (
        labels.withColumn("n", n)
        .groupBy(*by, "n")
        .agg(
            (F.sum("same") / F.col("n")).alias("agreement"),
            (F.sum(F.col("na") * F.col("nb")) / (F.col("n") * F.col("n"))).alias("expected"),
        )
        .withColumn(
            "kappa",
            F.when(F.col("expected") < 1, (F.col("agreement") - F.col("expected")) / (1 - F.col("expected"))),
        )
    )


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None, min_n: int = 0) -> DataFrame:
    """Kappa, PABAK and their labels, per group; groups under ``min_n`` are left out."""
    out = kappa_from(label_pairs(df, a, b, by), by or [])
    return out.where(F.col("n") >= min_n).withColumns(
        {
            "pabak": 2 * F.col("agreement") - 1,
            "band": kappa_band(F.col("kappa")),
            "acceptance": acceptance_band(F.col("kappa")),
        }
    )


def prevalence(df: DataFrame, raters: list[str]) -> DataFrame:
    """Share of each label per rater, in one pass over the table."""
    sides = F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("label")) for r in raters])
    counts = df.select(F.explode(sides).alias("s")).groupBy("s.rater", "s.label").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("rater")))


def label_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per label, how many rows both / either rater gave it, Jaccard and both marginals."""
    pairs = label_pairs(df, a, b)
    both = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)
    sides = F.array(
        F.struct(F.col("a").alias("label"), both.alias("both"), F.col("n").alias("n_a"), F.lit(0.0).alias("n_b")),
        F.struct(F.col("b").alias("label"), F.lit(0.0).alias("both"), F.lit(0.0).alias("n_a"), F.col("n").alias("n_b")),
    )
    sums = pairs.select(F.explode(sides).alias("s")).groupBy("s.label").agg(
        F.sum("s.both").cast("bigint").alias("both"),
        F.sum("s.n_a").cast("bigint").alias("n_a"),
        F.sum("s.n_b").cast("bigint").alias("n_b"),
    )
    either = F.col("n_a") + F.col("n_b") - F.col("both")
    return sums.withColumn("either", either).withColumn(
        "jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either"))
    )


def disagreement_by(df: DataFrame, reference: str, raters: list[str]) -> DataFrame:
    """Per reference answer, how often each rater differs from it."""
    facts = [F.count_if(F.col(r) != F.col(reference)).alias(r) for r in raters]
    wide = df.groupBy(reference).agg(F.count(F.lit(1)).alias("n"), *facts)
    rows = F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("n_differ")) for r in raters])
    return wide.select(reference, "n", F.explode(rows).alias("r")).select(
        reference, "r.rater", "n", "r.n_differ", (F.col("r.n_differ") / F.col("n")).alias("rate")
    )


def rater_accuracy(df: DataFrame, truth: str, raters: list[str]) -> DataFrame:
    """Per true category, how often each rater is right."""
    wide = df.groupBy(truth).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r) == F.col(truth)).alias(r) for r in raters]
    )
    rows = F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("n_right")) for r in raters])
    return wide.select(truth, "n", F.explode(rows).alias("r")).select(
        truth, "r.rater", "n", "r.n_right", (F.col("r.n_right") / F.col("n")).alias("accuracy")
    )


def with_key(df: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Annotated rows with their answer key."""
    return join_on(df, answers, [key])
