"""Edge rows of the text functions, rules and gates."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from qaloom.functions import rules, text
from qaloom.operators import gates, prompts


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Yes.", "yes"),
        (" no... ", "no"),
        ("cannot", "no"),
        ("I know", "no"),
        ("reject", "reject"),
        ("I must reject this", "reject"),
        ("reject, no", "no"),
        ("maybe", "invalid"),
        ("yes and no", "invalid"),
    ],
)
def test_parse_answer(spark, raw, expected):
    assert value(spark, text.parse_answer(F.lit(raw))) == expected
    strict = value(spark, text.parse_answer(F.lit(raw), strict=True))
    assert strict == (expected if raw.strip(" .").lower() in ("yes", "no", "reject") else "invalid")


@pytest.mark.parametrize(
    "prompt, threshold, polarity, reason",
    [
        ("Answered wider than 16 sec?", 16, "over", "ok"),
        ("Was the wait exceeded 14 min?", 14, "over", "ok"),
        ("Done in under 18 turns?", 18, "under", "ok"),
        ("Fewer than 17 messages?", 17, "under", "ok"),
        ("Exactly 5 messages?", 5, "equal", "ok"),
        ("Exactly under 5 messages?", 5, "under", "ok"),
        ("Was the 5 min SLA met, under 5?", 5, None, "blocked_external"),
        ("Under or over 5 minutes?", 5, None, "ambiguous"),
        ("Under 150 minutes?", 15, None, "threshold_not_in_text"),
        ("It took 15 minutes", 15, None, "no_keyword"),
        ("Within 5 minutes?", None, None, "threshold_not_in_text"),
    ],
)
def test_polarity(spark, prompt, threshold, polarity, reason):
    params = "{}" if threshold is None else '{"threshold": %s}' % threshold
    tag = value(spark, rules.polarity(F.lit(prompt), F.lit(params)))
    assert (tag.polarity, tag.reason) == (polarity, reason)


def test_polarity_of_missing_and_broken_params(spark):
    for params in [F.lit(None).cast("string"), F.lit("not json")]:
        assert value(spark, rules.polarity(F.lit("within 5"), params)).reason == "threshold_not_in_text"


def test_extractors(spark):
    time = value(spark, rules.extract_time(F.lit("Reply in 2.5 hrs, not slow")))
    assert (time.threshold, time.unit, time.operator) == (2.5, "hours", ">")
    assert value(spark, rules.extract_time(F.lit("no number"))) is None
    for prompt, n in [
        ("12 messages", 12),
        ("15 or more turns", 15),
        ("turn count exceeded 18", 18),
        ("more than 7 of them", 7),
        ("no number", None),
    ]:
        assert value(spark, rules.extract_count(F.lit(prompt))) == n
    for prompt, expected in [
        ("Is there an internal note?", ("notes", None)),
        ("Was the chat channel tagged 'urgent'?", ("channel", "chat")),
        ("Did the email carry the 'vip' tag?", ("tag", "vip")),
        ("Was it by phone?", ("channel", "phone")),
    ]:
        got = value(spark, rules.extract_metadata(F.lit(prompt)))
        assert (got.subtype, got.value) == expected
    assert value(spark, rules.extract_metadata(F.lit("nothing here"))) is None


def test_deployed_extractability_keeps_its_quirks(spark):
    def ok(prompt, category, params):
        return value(spark, rules.literally_extractable(F.lit(prompt), F.lit(category), F.lit(params)))

    assert ok("within 150 s", "SYMBOLIC_TIME", '{"threshold": 15}')
    assert ok("none left", "SYMBOLIC_METADATA", '{"subtype": "notes", "value": null}')
    assert not ok("a note", "SYMBOLIC_METADATA", '{"subtype": "notes", "value": null}')
    assert not ok("5", "SEMANTIC", '{"threshold": 5}')


@pytest.mark.parametrize(
    "prompt, route",
    [
        ("Reply within 5 minutes?", "SYMBOLIC_TIME"),
        ("How many messages?", "SYMBOLIC_COUNT"),
        ("Is it tagged 'a'?", "SYMBOLIC_METADATA"),
        ("Within 5 minutes and polite?", "HYBRID"),
        ("Predict churn", "UNSUPPORTED"),
        ("Predict churn within 5 minutes", "SYMBOLIC_TIME"),
        ("Was it fine?", "SEMANTIC"),
    ],
)
def test_keyword_route(spark, prompt, route):
    assert value(spark, rules.keyword_route(F.lit(prompt))) == route


def test_labels(spark):
    assert value(spark, text.kappa_band(F.lit(0.805))) == "Unknown"
    assert value(spark, text.kappa_band(F.lit(0.80))) == "Substantial"
    assert value(spark, text.template_family(F.lit("meta_tag"))) == "meta_tag"
    assert value(spark, text.template_family(F.lit("x"))) == "other"
    assert value(spark, text.length_band(F.lit(1000))) is None
    assert value(spark, text.stars(F.lit(0.01))) == "*"
    assert value(spark, text.clean_label(F.lit(" nan "))) is None
    assert value(spark, text.template_of(F.lit(" A 12\n b "))) == "a <NUM> b"
    assert value(spark, text.collapse_category(F.lit("SEMANTIC_TONE"))) == "SEMANTIC"


def test_prompts_do_not_depend_on_partitioning(spark):
    seeds = spark.range(300)
    once = prompts.perturb(prompts.expand_templates(seeds, "id"), "id", "prompt", "noise")
    again = prompts.perturb(prompts.expand_templates(seeds.repartition(7), "id"), "id", "prompt", "noise")
    assert sorted(once.collect()) == sorted(again.collect())
    assert once.where(F.col("prompt").isNull() | F.col("prompt").contains("{")).count() == 0


def test_gates_report_violations(spark):
    rows = spark.createDataFrame(
        [
            (1, "SYMBOLIC_TIME", "within 5 minutes", '{"threshold": 5, "operator": "<="}', "yes"),
            (2, "SYMBOLIC_TIME", "within 5 minutes", '{"threshold": 5, "operator": ">"}', "no"),
            (2, "SYMBOLIC_COUNT", "5 messages", '{"threshold": 5, "operator": ">"}', None),
            (3, "SYMBOLIC_COUNT", "under 5 messages", '{"threshold": 5}', "no"),
        ],
        "id bigint, category string, prompt string, params string, truth string",
    )
    found = gates.rule_counts(
        gates.category_counts(rows, "category", {"SYMBOLIC_TIME": 2, "SYMBOLIC_COUNT": 1}),
        gates.unique_and_complete(rows, "id", "truth"),
        gates.operators_agree(rows, "id", "category", "prompt", "params"),
        gates.answers_agree(rows, "id", "truth", {"self": "truth"}),
    )
    assert {r.rule: r.n_violations for r in found.collect()} == {
        "V1_category_count": 1,
        "V2_duplicate_key": 1,
        "V2_missing_truth": 1,
        "V3_polarity_differs": 1,
        "V3_not_parseable": 1,
        "V3_missing_operator": 1,
    }


def test_word_boundaries_are_ascii_as_in_sql(spark):
    # "ß" is no word character in SQL, so "in under" starts a word here.
    text = "Wien, Gruß" + "in under 7 minutes"
    df = spark.createDataFrame([(text, '{"threshold": 7}'), ("ü7ü under", '{"threshold": 7}')], "p string, q string")
    tag = rules.polarity(F.col("p"), F.col("q"))
    got = df.withColumn("tag", tag).select("tag.reason", rules.matched_keywords(F.col("p"), F.col("tag"))).collect()
    found = duckdb.execute("SELECT regexp_extract(?, ?), regexp_matches('ü7ü under', '\\b\\Q7\\E\\b')", [text.lower(), r"\bin under\b"]).fetchone()
    assert found == ("in under", True)
    assert [tuple(r) for r in got] == [("ok", ["under", "in under"]), ("ok", ["under"])]


def test_every_rule_is_evaluated_once_a_prompt(spark):
    df = spark.createDataFrame([("within 7 minutes", '{"threshold": 7}')], "p string, q string")
    plan = df.select(rules.keyword_route(F.col("p")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(part) == 1 for part in ["turnaround", "leng?thy", "flagg?ed", "churn"])
    plan = df.select(rules.polarity(F.col("p"), F.col("q")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(part) == 1 for part in ["streamlined", "precisely", "$.threshold"])


@pytest.mark.parametrize(
    "spelled, prompt, there",
    [("7", "in 7 turns", True), ("7", "in 17 turns", False), ("7", "ü7ü", True), ("007", "in 7 turns", True), ("1.5", "1.5h", False), ("1.5", "in 1.5 h", True), ("1.5", "in 1 h", True), ("7", None, False)],
)
def test_a_threshold_is_a_whole_word(spark, spelled, prompt, there):
    df = spark.createDataFrame([(prompt, f'{{"threshold": "{spelled}"}}')], "p string, q string")
    assert bool(df.select(rules.threshold_in_text(F.col("p"), F.col("q"))).first()[0]) is there


def test_wording_is_looked_for_in_one_lowered_text(spark):
    sides = {"blocked_external": rules.BLOCKED, "ambiguous": rules.UNDER + rules.OVER, "under": rules.UNDER, "over": rules.OVER, "equal": rules.EQUAL}
    bits = ["Under", "under the", "überunder", "thunder", "stay under", "before 12  messages", "before x", "kept it below", "sub-7", "subs", "surpassed", "surpasses", "w/in", "too many", "delays", "xdelay", "drawn-out", "equals", "more than", "longer tham", "7", "\n", "_past", "past"]
    rng = random.Random(4)
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(150)] + [None, "", "equals 7"]
    df = spark.createDataFrame([(t, '{"threshold": 7}') for t in texts], "p string, q string").withColumn("tag", rules.polarity(F.col("p"), F.col("q")))
    found = df.select("p", F.coalesce("tag.polarity", "tag.reason").alias("told"), rules.matched_keywords(F.col("p"), F.col("tag")).alias("words"))
    for r in found.collect():
        hits = [re.search(x, (r.p or "").lower(), re.ASCII) for x in sides.get(r.told, [])]
        assert r.words == [h[0] for h in hits if h]
    assert {"blocked_external", "ambiguous", "under", "over", "equal", "threshold_not_in_text"} <= {r.told for r in found.collect()}
    plan = found.drop("told")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2  # the tag's and the wording's
