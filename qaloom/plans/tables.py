"""The operators' inputs, derived from the given tables.

Prompts are expanded one per order; conversations are the events of a user; pairs join the two on
the customer; labelled documents carry several rule predictors; repeated runs are events. Every
table keeps all of its input rows, so its size grows with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.functions import draws, rules
from qaloom.functions.staging import computed
from qaloom.functions.text import parse_answer
from qaloom.operators import conversations as conv
from qaloom.operators import curation, prompts, routing
from qaloom.schemas import CLASSES
from qaloom.session import lookup

TAG_VALUE = 150.0
PROMPTS_PER_TASK = 50_000
LANGS = ["de", "en", "es", "fr"]
SYSTEMS = ["length", "words", "random", "constant"]
MODELS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of fewer splits than cores, hashed over the cores; larger tables stay as read.

    One small file is one task, however costly the expressions on it. At scale the scan has more
    splits than cores and nothing is shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def prompt_tasks(seeds: DataFrame) -> int:
    """Tasks for the rules of prompts: their number grows with the rows, so no task does, however few splits the small seeds have."""
    return max(seeds.sparkSession.sparkContext.defaultParallelism, math.ceil(seeds.count() / PROMPTS_PER_TASK))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def event_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Flat conversations: a user's events in order; errors are private agent notes."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("conv_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(kind.isin("view", "purchase"), "customer").otherwise("agent").alias("role"),
        (kind != "error").alias("is_public"),
        F.when(F.col("value") > TAG_VALUE, kind).alias("tag"),
        F.col("props").alias("text"),
    )


def turn_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Flat conversations without times: system turns are private."""
    role = F.col("role")
    return table(spark, sf, "conversations").select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.when(role == "user", "customer").otherwise("agent").alias("role"),
        (role != "system").alias("is_public"),
        "text",
    )


def conversation_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user with everything the symbolic dispatch reads."""
    flat = conv.flat_features(event_messages(spark, sf), tag="tag")
    return flat.withColumn("channel", draws.pick(prompts.CHANNELS, "channel", F.col("conv_id")))


def prompt_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The key of every order, as seed of one prompt, with the conversation it is asked about."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("conv_id")
    )


def prompt_table(spark: SparkSession, sf: str) -> DataFrame:
    """One clean prompt per order: id, conv_id and the prompt columns."""
    seeds = prompt_seeds(spark, sf)
    return prompts.expand_templates(seeds.repartition(prompt_tasks(seeds), "id"), "id")


def noisy_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.perturb(prompt_table(spark, sf), "id", "prompt", "noise")


def admitted_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return admitted(prompt_table(spark, sf))


def admitted(rows: DataFrame) -> DataFrame:
    """Prompts with TIME and COUNT rows kept only if their wording gives an operator."""
    ruled = F.col("category").isin("SYMBOLIC_TIME", "SYMBOLIC_COUNT")
    tagged = computed(rows, {"__tag": F.when(ruled, rules.polarity(F.col("prompt"), F.col("params")))})
    usable = tagged.where(~ruled | F.coalesce(F.col("__tag.polarity").isin("under", "over"), F.lit(False)))
    operator = rules.polarity_operator(F.col("__tag.polarity"), F.col("category"))
    with_op = curation.with_operator(F.col("params"), operator)
    return usable.withColumn("params", F.when(ruled, with_op).otherwise(F.col("params"))).drop("__tag")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation pairs: prompts with their customer's conversation features, truth, two routers
    and a stored judge."""
    key = F.col("id")
    facts = lookup(conversation_features(spark, sf), row_bytes=256)
    seeds = prompt_seeds(spark, sf)
    # Dealt out after the join: a shuffled one leaves as many tasks as there are cores, and hot customers in one of them.
    seeds = seeds.join(facts, "conv_id", "left").repartition(prompt_tasks(seeds), "id")
    # A conversation without messages has no times, no tags and no notes.
    empty = {"channel": F.lit(""), "n_public": F.lit(0), "n_messages": F.lit(0), "has_notes": F.lit(False), "tags": F.array()}
    seeds = seeds.withColumns({c: F.coalesce(F.col(c), v.cast(seeds.schema[c].dataType)) for c, v in empty.items()})
    joined = admitted(prompts.expand_templates(seeds, "id"))
    symbolic = F.col("category").startswith("SYMBOLIC")
    judged = F.when(draws.unit("judged", key) < 0.6, "yes").otherwise("no")
    truth = (
        F.when(symbolic, conv.symbolic_answer(F.col("category"), F.col("params"), "rescore"))
        .when(F.col("category") == "UNSUPPORTED", "reject")
        .otherwise(judged)
    )
    right = draws.unit("router", key) < 0.9
    confidence = 0.2 + 0.5 * draws.unit("confidence", key) + F.when(right, 0.3).otherwise(0.0)
    said = F.when(draws.unit("judge", key) < 0.7, F.col("truth")).otherwise(
        draws.pick(["yes", "no", "maybe", "cannot say"], "reply", key)
    )
    with_truth = computed(joined, {"truth": truth})
    return (
        computed(
            with_truth,
            {
                "pred_learned": F.when(right, F.col("category")).otherwise(
                    draws.pick(CLASSES, "misroute", key)
                ),
                "conf_learned": F.round(confidence, 4),
                "pred_keyword": rules.keyword_route(F.col("prompt")),
                "conf_keyword": F.lit(1.0),
                "judge_answer": parse_answer(said),
                "judge_tokens": 200 + draws.draw("tokens", key) % 300,
                "judge_latency_ms": F.round(100.0 + 900.0 * draws.unit("latency", key), 2),
            },
        )
        .withColumn(
            "truth_source",
            F.when(symbolic, "deterministic")
            .when(F.col("category") == "UNSUPPORTED", "rejection")
            .otherwise("judge"),
        )
    )


def routed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with the answer and correctness of five systems."""
    p, params = pairs(spark, sf), F.col("params")
    judge, category = F.col("judge_answer"), F.col("category")
    fallback = routing.with_fallback(F.col("pred_learned"), F.col("conf_learned"), 0.5)
    answers = {
        "judge": judge,
        "routed": routing.routed(fallback, params, judge),
        "keyword": routing.routed(F.col("pred_keyword"), params, judge),
        "strict": routing.routed_strict(F.col("pred_learned"), category, params, judge),
        "deployed": routing.routed_deployed(
            F.col("pred_learned"), category, F.col("prompt"), params, judge
        ),
    }
    out = computed(p, {f"{name}_answer": a for name, a in answers.items()})
    flags = {
        f"{name}_correct": F.col(f"{name}_answer").eqNullSafe(F.col("truth")).cast("int")
        for name in answers
    }
    return out.withColumns(flags)


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with four rule predictors of quality and their correctness."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    guesses = {
        "length": (F.col("n_chars") > 1000).cast("int"),
        "words": F.lower("text").contains(" the ").cast("int"),
        "random": (draws.unit("guess", F.col("doc_id")) < 0.8).cast("int"),
        "constant": F.lit(1),
    }
    scored = docs.select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic", *[g.alias(n) for n, g in guesses.items()]
    )
    return scored.withColumns(
        {f"{n}_correct": (F.col(n) == F.col("quality")).cast("int") for n in guesses}
    )


def document_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """A language guess per document: probabilities in class order, prediction, confidence."""
    raw = F.array(
        *[
            draws.unit(f"p:{lang}", F.col("doc_id")) + F.when(F.col("lang") == lang, 1.0).otherwise(0.0)
            for lang in LANGS
        ]
    )
    docs = documents(spark, sf).select("doc_id", "lang", raw.alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda s, x: s + x)
    p = F.transform("raw", lambda x: x / F.col("total"))
    names = F.array(*[F.lit(x) for x in LANGS])
    return (
        docs.withColumn("total", total)
        .withColumn("probabilities", p)
        .withColumn("confidence", F.array_max("probabilities"))
        .withColumn(
            "prediction",
            F.get(names, (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")),
        )
        .drop("raw", "total")
    )


def repeat_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated runs: the event type is the model, the user the item, the answer from the value."""
    user, event, value = F.col("user_id"), F.col("event_id"), F.col("value")
    answer = F.when(value < 15, "no").when(value < 150, "yes").otherwise("invalid")
    truth = F.when(draws.unit("truth", user) < 0.8, "yes").otherwise("no")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("model"),
        (draws.draw("run", event) % 5).cast("int").alias("run"),
        user.alias("idx"),
        draws.pick(["SYMBOLIC_TIME", "SYMBOLIC_COUNT", "SYMBOLIC_METADATA"], "cat", user).alias("category"),
        answer.alias("answer"),
        truth.alias("ground_truth"),
        (answer == truth).cast("int").alias("correct"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        (20 + draws.draw("length", user) % 100).alias("prompt_len"),
        value.alias("latency_ms"),
    )


def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with an exact 70/15/15 split per language."""
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    return curation.stratified_split(docs, "lang", "doc_id")
