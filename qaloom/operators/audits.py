"""Audits of prompt tables: diversity, lengths, leakage, overlap and surface form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import rules, text
from qaloom.operators.ranking import join_on, percentiles
from qaloom.session import lookup


def type_token_ratio(df: DataFrame, category: str, prompt: str) -> DataFrame:
    """Distinct words over all words per category; words are counted before they are shuffled."""
    words = df.select(category, F.explode(text.tokens(F.col(prompt))).alias("word"))
    counts = words.groupBy(category, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(category).agg(
        F.count(F.lit(1)).alias("n_types"),
        F.sum("n").alias("n_tokens"),
        (F.count(F.lit(1)) / F.sum("n")).alias("ttr"),
    )


def length_statistics(df: DataFrame, prompt: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median, max and spread of text lengths, and how many fall in each band."""
    by = by or []
    sized = df.select(*by, F.length(prompt).alias("len"))
    keys = by or ["__all"]
    sized = sized if by else sized.withColumn("__all", F.lit(0))
    band = text.length_band(F.col("len"))
    sums = sized.groupBy(*keys).agg(
        F.count("len").alias("n"),
        F.avg("len").alias("mean_len"),
        F.max("len").alias("max_len"),
        F.stddev_samp("len").alias("std_len"),
        *[F.count_if(band == b).alias(f"n_{b}") for b in ["short", "medium", "long"]],
    )
    middle = percentiles(sized, keys, "len", {"median_len": 0.5})
    if not by:
        middle = middle.withColumn("__all", F.lit(0))
    return join_on(sums, middle, keys, "left").drop("__all")


def vocabulary_leaks(df: DataFrame, category: str, prompt: str, inside: float = 0.25, outside: float = 0.05) -> DataFrame:
    """Words in at least a quarter of one category's texts and under 5% of all others.

    One document-frequency table per (word, category); the totals outside follow by subtraction.
    Words are counted once per document where the document is read.
    """
    words = df.select(category, F.inline(text.counted(text.tokens(F.col(prompt)))))
    sizes = df.groupBy(category).agg(F.count(F.lit(1)).alias("n_docs"))
    sizes = lookup(sizes)
    n_all = sizes.agg(F.sum("n_docs")).first()[0]
    per = words.groupBy(F.col("term").alias("word"), category).agg(F.count(F.lit(1)).alias("df"))
    # One row per word with its few categories, so each word meets its own total without a join.
    whole = per.groupBy("word").agg(
        F.sum("df").alias("df_all"), F.collect_list(F.struct(category, "df")).alias("parts")
    )
    rows = whole.select("word", "df_all", F.inline("parts"))
    rows = join_on(rows, sizes, [category]).where(F.col("df") >= inside * F.col("n_docs"))
    others = F.lit(n_all) - F.col("n_docs")
    out = F.when(others > 0, (F.col("df_all") - F.col("df")) / others).otherwise(0.0)
    return rows.select(
        "word", category, (F.col("df") / F.col("n_docs")).alias("freq_in"), out.alias("freq_out")
    ).where(F.col("freq_out") < outside)


def keyword_leakage(df: DataFrame, category: str, prompt: str, words: dict[str, list[str]] | None = None) -> DataFrame:
    """Share of a category's texts that contain each of its forbidden words."""
    words = words or rules.FORBIDDEN
    lowered = F.lower(F.col(prompt))
    own = F.create_map(
        *[x for c, ws in words.items() for x in (F.lit(c), F.array(*[F.lit(w) for w in ws]))]
    )
    listed = df.where(F.col(category).isin(*words)).select(category, lowered.alias("__t"))
    hits = listed.select(category, "__t", F.explode(own[F.col(category)]).alias("word"))
    return hits.groupBy(category, "word").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.contains(F.col("__t"), F.col("word"))).alias("n_hit"),
        F.avg(F.contains(F.col("__t"), F.col("word")).cast("double")).alias("share"),
    )


def surface_noise(df: DataFrame, prompt: str, by: list[str] | None = None) -> DataFrame:
    """Shares of lower-case starts, missing final marks, doubled marks and informal words."""
    p = F.col(prompt)
    first = F.substring(p, 1, 1)
    last = F.regexp_extract(p, r"(\S)\s*$", 1)
    # Informal wording.
    informal = ["plz", "gonna", "wanna", "cuz", " u "]
    signs = {
        "lower_start": (first != F.upper(first)) & (p != ""),
        "no_final_mark": ~last.isin(".", "?", "!", "") & (p != ""),
        "doubled_marks": p.contains("??") | p.contains("..."),
        "informal": F.lower(p).rlike("|".join(informal)),
    }
    rows = df.groupBy(*by) if by else df.groupBy()
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(s.cast("double")).alias(name) for name, s in signs.items()],
    )


def style_audit(df: DataFrame, prompt: str, style: str) -> DataFrame:
    """How often the stored style and the question mark disagree, by direction."""
    asks, labelled = F.col(prompt).contains("?"), F.col(style) == "question"
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(asks != labelled).alias("n_mismatch"),
        F.count_if(asks & ~labelled).alias("n_question_as_instruction"),
        F.count_if(~asks & labelled).alias("n_instruction_as_question"),
    )


def template_overlap(train: DataFrame, test: DataFrame, category: str, prompt: str) -> DataFrame:
    """Overlap of digit-masked templates, "ALL" on distinct templates, else on test rows."""
    template = F.sha2(text.template_of(F.col(prompt)), 256).alias("template")  # digests are shuffled, not texts
    seen = train.select(template).distinct().withColumn("seen", F.lit(True))
    counted = test.select(category, template).groupBy("template", category).agg(F.count(F.lit(1)).alias("n"))
    marked = counted.join(seen, "template", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    per = marked.groupBy(category).agg(
        F.sum("n").alias("n_test"), F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0)).alias("n_overlap")
    )
    single = marked.groupBy("template").agg(F.max("seen").alias("seen"))
    whole = single.agg(F.count(F.lit(1)).alias("n_test"), F.count_if("seen").alias("n_overlap"))
    both = per.unionByName(whole.select(F.lit("ALL").alias(category), "n_test", "n_overlap"))
    share = F.when(F.col("n_test") > 0, 100.0 * F.col("n_overlap") / F.col("n_test")).otherwise(0.0)
    return both.withColumn("overlap_percent", share)


def exact_overlap(train: DataFrame, test: DataFrame, prompt: str) -> DataFrame:
    """Prompts that occur in both tables, as a set.

    Digests find them; only texts of the common ones are shuffled.
    """
    digest = F.sha2(F.coalesce(F.concat(F.lit("t"), F.col(prompt)), F.lit("")), 256).alias("__digest")
    common = train.select(digest).intersect(test.select(digest))
    found = test.select(prompt, digest).join(common, "__digest", "left_semi")
    return found.groupBy("__digest").agg(F.first(prompt).alias(prompt)).select(prompt)


def extraction_scores(df: DataFrame, prompt: str, category: str, subcategory: str, params: str) -> DataFrame:
    """How well the extractors recover the stored parameters: total, per category, per subcategory."""
    stored = F.from_json(F.col(params), "threshold DOUBLE, unit STRING, subtype STRING, value STRING")
    rows = df.where(F.col(category).startswith("SYMBOLIC")).select(
        category,
        subcategory,
        stored.alias("s"),
        rules.extract_time(F.col(prompt)).alias("t"),
        rules.extract_count(F.col(prompt)).alias("c"),
        rules.extract_metadata(F.col(prompt)).alias("m"),
    )
    timed, counted = F.col(category) == "SYMBOLIC_TIME", F.col(category) == "SYMBOLIC_COUNT"

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.lower(a), F.lit("")) == F.coalesce(F.lower(b), F.lit(""))

    found = F.when(timed, F.col("t").isNotNull()).when(counted, F.col("c").isNotNull()).otherwise(F.col("m").isNotNull())
    threshold = (
        F.when(timed, F.col("t.threshold").eqNullSafe(F.col("s.threshold")))
        .when(counted, F.col("c").cast("double").eqNullSafe(F.col("s.threshold")))
        .otherwise(F.lit(True))
    )
    unit = F.when(timed, same(rules.unit_name(F.col("t.unit")), rules.unit_name(F.col("s.unit")))).otherwise(F.lit(True))
    meta = ~timed & ~counted
    subtype = F.when(meta, F.col("m.subtype").eqNullSafe(F.col("s.subtype"))).otherwise(F.lit(True))
    value = F.when(
        meta & F.coalesce(F.col("s.subtype") != "notes", F.lit(True)), same(F.col("m.value"), F.col("s.value"))
    ).otherwise(F.lit(True))
    flags = {
        "extracted": found,
        "match_threshold": found & threshold,
        "match_unit": found & unit,
        "match_subtype": found & subtype,
        "match_value": found & value,
        "correct": found & threshold & unit & subtype & value,
    }
    flagged = rows.select(category, subcategory, *[f.alias(n) for n, f in flags.items()])
    sets = flagged.groupingSets([[category], [subcategory], []], category, subcategory)
    return sets.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(n).alias(n) for n in flags]
    ).select(
        F.coalesce(category, F.lit("ALL")).alias(category),
        F.coalesce(subcategory, F.lit("ALL")).alias(subcategory),
        "n",
        *flags,
    )
