"""De-duplication, splits, samples, set operations and benchmark assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions import draws, rules, text
from qaloom.functions.staging import computed
from qaloom.operators.ranking import ROWS_PER_TASK, join_on, rank_cuts, ranked, top_ranked
from qaloom.session import lookup


def dedup_exact(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key value, "first" by the (unique) order column.

    Rows are told apart by the SHA-256 of the key. Only digests and order values are shuffled, and
    counted where they are read, so a text that makes up a third of the table is no hot task. The
    rows themselves then meet a table of the repeated digests alone.
    """
    marked = df.withColumn("__digest", F.unhex(F.sha2(F.col(key), 256)))
    groups = marked.groupBy("__digest").agg(
        F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    repeated = lookup(groups.where(F.col("__n") > 1).select("__digest", "__first"))
    joined = join_on(marked, repeated, ["__digest"], "left")
    keep = F.col("__first").isNull() | (F.col("__first") == F.col(order))
    return joined.where(keep).select(*df.columns)


def stratified_split(
    df: DataFrame,
    stratum: str,
    key: str,
    seed: str = "split",
    train: float = 0.70,
    validation: float = 0.15,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """P5: exact per-class sizes floor(n*train), floor(n*validation), the remainder to test.

    The rows themselves are not shuffled: each class's two cut points are found among draws and
    keys alone, and every row compares its own draw with them.
    """

    def first(n: Column) -> Column:
        return F.floor(n * F.lit(train))

    def second(n: Column) -> Column:
        return first(n) + F.floor(n * F.lit(validation))

    cuts = lookup(rank_cuts(df, [stratum], key, seed, [first, second], rows_per_task))
    here = F.struct(draws.draw(seed, F.col(key)).alias("d"), F.col(key).alias("k"))
    split = (
        F.when(F.coalesce(here < F.col("cut0"), F.lit(True)), "train")
        .when(F.coalesce(here < F.col("cut1"), F.lit(True)), "val")
        .otherwise("test")
    )
    return join_on(df, cuts, [stratum]).select(*df.columns, split.alias("split"))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "sample") -> DataFrame:
    """N rows per class."""
    return top_ranked(df, [stratum], [draws.draw(seed, F.col(key)), F.col(key)], n)


def balanced_sample(
    df: DataFrame, label: str, key: str, n_first: int, n_total: int, first: str = "yes", seed: str = "balance"
) -> DataFrame:
    """Up to n_first rows with the first label, the other label filling up to n_total."""
    top = top_ranked(df, [label], [draws.draw(seed, F.col(key)), F.col(key)], n_total)
    is_first = F.col(label) == first
    # At most 2 * n_total rows are left here.
    taken = F.least(F.lit(n_first), F.count_if(is_first).over(Window.partitionBy(F.lit(0))))
    return (
        top.withColumn("__taken", taken)
        .where(F.col("rank") <= F.when(is_first, F.col("__taken")).otherwise(n_total - F.col("__taken")))
        .drop("__taken", "rank")
    )


def capped_sample(df: DataFrame, key: str, n: int, seed: str = "cap") -> DataFrame:
    """min(n, all) rows, by smallest draw."""
    return df.orderBy(draws.draw(seed, F.col(key)), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: str = "shuffle") -> DataFrame:
    """A repeatable random order (a range-partitioned sort)."""
    return df.orderBy(draws.draw(seed, F.col(key)), key)


def remove_seen(df: DataFrame, prompt: str, *seen: DataFrame) -> DataFrame:
    """Rows whose lower-cased, trimmed prompt occurs in none of the other tables.

    Digests are shuffled, not texts.
    """

    def key(c: str) -> Column:
        return F.sha2(F.trim(F.lower(F.col(c))), 256)

    known = None
    for other in seen:
        part = other.select(key(prompt).alias("__seen"))
        known = part if known is None else known.unionByName(part)
    return df.join(known.distinct(), key(prompt) == F.col("__seen"), "left_anti")


def blind_sheet(df: DataFrame, key: str, shown: list[str], hidden: list[str], seed: str = "sheet"):
    """(sheet, key) for blind annotation: shuffled ids, the truth only in the second."""
    numbered = ranked(df, [], key, seed).withColumn("id", F.col("rank") + 1)
    sheet = numbered.select(
        "id", *shown, F.lit("").alias("annotator_answer"), F.lit("").alias("notes")
    )
    return sheet, numbered.select("id", key, *shown, *hidden)


def with_polarity(df: DataFrame, prompt: str = "prompt", params: str = "params") -> DataFrame:
    """T1 as columns ``polarity`` and ``reason``."""
    tag = rules.polarity(F.col(prompt), F.col(params))
    tagged = computed(df, {"__tag": tag})
    return tagged.select(
        *df.columns, F.col("__tag.polarity").alias("polarity"), F.col("__tag.reason").alias("reason")
    )


def admitted(df: DataFrame, category: str = "top_category") -> DataFrame:
    """T5: TIME and COUNT prompts whose polarity is under or over."""
    pool = df.where(F.col(category).isin("SYMBOLIC_TIME", "SYMBOLIC_COUNT"))
    return with_polarity(pool).where(F.col("polarity").isin("under", "over"))


def with_operator(params: Column, operator: Column) -> Column:
    """The params document with its operator added."""
    body = F.regexp_replace(params, r"\}\s*$", "")
    return F.concat(body, F.lit(', "operator": "'), operator, F.lit('"}'))


# Benchmark size per category, in output order.
TARGETS = {
    "SYMBOLIC_TIME": 65,
    "SYMBOLIC_COUNT": 60,
    "SYMBOLIC_METADATA": 50,
    "SEMANTIC": 60,
    "HYBRID": 40,
    "UNSUPPORTED": 30,
}


def assemble_benchmark(
    test: DataFrame, pool: DataFrame, key: str, targets: dict[str, int] | None = None, seed: str = "bench"
) -> DataFrame:
    """P10: the evaluation prompts, per-category counts exact unless the tables run short.

    TIME and COUNT take the first test prompts in key order; those without a usable polarity are
    replaced, one for one, by unused admitted prompts of the pool. METADATA takes the first, the
    other categories a random draw. Every intermediate after the first ranking is bounded by the
    target counts, and replacement is a join on rank, not a retry loop.
    """
    targets = targets or TARGETS
    order = list(targets)
    quota = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    category, most = F.col("top_category"), max(targets.values())
    by_draw = draws.draw(seed, F.col(key))
    in_order = test.where(
        category.isin("SYMBOLIC_TIME", "SYMBOLIC_COUNT", "SYMBOLIC_METADATA")
        & F.col("params").isNotNull()
    )
    at_random = test.where(category.isin("SEMANTIC", "HYBRID", "UNSUPPORTED"))
    first = top_ranked(in_order, ["top_category"], [F.col(key)], most)
    drawn = top_ranked(at_random, ["top_category"], [by_draw, F.col(key)], most)
    chosen = first.unionByName(drawn).where(F.col("rank") <= quota[category])
    chosen = with_polarity(chosen).select(
        key, "top_category", "prompt", "params", "polarity", "reason", "rank"
    )

    ruled = category.isin("SYMBOLIC_TIME", "SYMBOLIC_COUNT")
    usable = F.coalesce(F.col("polarity").isin("under", "over"), F.lit(False))
    kept = chosen.where(~ruled | usable).withColumn("origin", F.lit("kept"))
    failing = Window.partitionBy("top_category").orderBy("rank")
    gaps = chosen.where(ruled & ~usable).select(
        "top_category", "rank", F.row_number().over(failing).alias("__gap")
    )
    spare = admitted(pool).join(kept.select("prompt"), "prompt", "left_anti")
    spare = dedup_exact(spare.select(key, "top_category", "prompt", "params", "polarity", "reason"), "prompt", key)
    spare = top_ranked(spare, ["top_category"], [by_draw, F.col(key)], most)
    replaced = (
        spare.withColumnRenamed("rank", "__gap")
        .join(gaps, ["top_category", "__gap"])
        .drop("__gap")
        .withColumn("origin", F.lit("replaced"))
    )
    rows = kept.unionByName(replaced)
    position = Window.orderBy(text.category_rank(category, order), "rank")
    operator = rules.polarity_operator(F.col("polarity"), category)
    return (
        rows.withColumn("conversation_idx", F.row_number().over(position) - 1)
        .withColumn(
            "params",
            F.when(ruled, with_operator(F.col("params"), operator)).otherwise(F.col("params")),
        )
        .withColumn("scenario", scenario(category, F.col("rank") - 1, F.col("conversation_idx"), F.col("params")))
        .withColumn(
            "ground_truth_source",
            F.when(category.startswith("SYMBOLIC"), "deterministic")
            .when(category == "UNSUPPORTED", "rejection")
            .otherwise("judge"),
        )
        .drop("reason")
    )


def scenario(category: Column, position: Column, idx: Column, params: Column) -> Column:
    """TIME and COUNT cycle through three scenarios, METADATA alternates presence."""
    cycle = F.array(F.lit("clear_yes"), F.lit("clear_no"), F.lit("boundary"))
    subtype = F.coalesce(F.get_json_object(params, "$.subtype"), F.lit("tag"))
    even = idx % 2 == 0

    def either(yes: str, no: str) -> Column:
        return F.when(even, F.lit(yes)).otherwise(F.lit(no))

    return (
        F.when(
            category.isin("SYMBOLIC_TIME", "SYMBOLIC_COUNT"),
            F.get(cycle, (position % 3).cast("int")),
        )
        .when(
            category == "SYMBOLIC_METADATA",
            F.when(subtype == "tag", either("tag_present", "tag_absent"))
            .when(subtype == "channel", either("channel_match", "channel_mismatch"))
            .otherwise(either("notes_present", "notes_absent")),
        )
        .when(category == "UNSUPPORTED", "unanswerable")
        .otherwise("standard")
    )
