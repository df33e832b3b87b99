"""Edge rows of the conversation checks, nested and flat."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from qaloom.functions import checks
from qaloom.operators import conversations as conv
from qaloom.operators import routing
from qaloom.streaming import scoring


def message(role, minute, public=True, second=0):
    return {
        "role": role,
        "text": "t",
        "timestamp": f"2024-01-01 10:{minute:02d}:{second:02d}",
        "is_public": public,
        "channel": "chat",
    }


def document(messages, tags=(), channel="chat"):
    return json.dumps({"messages": messages, "tags": list(tags), "channel": channel})


def features(spark, documents, independent=False):
    rows = spark.createDataFrame(list(enumerate(documents)), "id bigint, doc string")
    parsed = rows.withColumn("c", conv.parse_conversation(F.col("doc"), independent))
    return conv.nested_features(parsed, "c", independent)


CASES = [
    ([message("agent", 0)], None, None),
    ([message("customer", 0)], None, None),
    ([message("agent", 0), message("customer", 5), message("agent", 12)], 7.0, -5.0),
    ([message("customer", 0), message("agent", 2, public=False), message("agent", 9)], 9.0, 2.0),
    ([message("customer", 0, public=False), message("customer", 3), message("agent", 4)], 1.0, 4.0),
    ([message("customer", 5), message("agent", 5), message("agent", 6, second=30)], 1.5, 0.0),
]


def test_first_response_forms_differ_only_as_documented(spark):
    docs = [document(m) for m, _, _ in CASES]
    production = [r.response_minutes for r in features(spark, docs).orderBy("id").collect()]
    independent = [r.response_minutes for r in features(spark, docs, True).orderBy("id").collect()]
    assert production == [p for _, p, _ in CASES]
    assert independent == [i for _, _, i in CASES]


def test_flat_equals_nested(spark):
    rows = []
    for i, (messages, _, _) in enumerate(CASES):
        rows += [(i, s, m["role"], m["timestamp"], m["is_public"]) for s, m in enumerate(messages)]
    flat = spark.createDataFrame(rows, "conv_id bigint, seq bigint, role string, t string, is_public boolean")
    flat = flat.select("conv_id", "seq", "role", F.col("t").cast("timestamp_ntz").alias("ts"), "is_public")
    for shuffled in [flat, flat.repartition(7, "ts")]:
        got = {r.conv_id: r.response_minutes for r in conv.first_response_flat(shuffled).collect()}
        assert got == {i: p for i, (m, p, _) in enumerate(CASES) if any(x["role"] == "customer" for x in m)}
        a = {r.conv_id: r.response_minutes for r in conv.first_response_independent_flat(flat).collect()}
        b = {r.conv_id: r.response_minutes for r in conv.first_response_independent_joined(flat).collect()}
        assert a == b == {i: x for i, (_, _, x) in enumerate(CASES)}


def answers(spark, doc, category, params, mode="production"):
    rows = features(spark, [doc]).withColumn("p", F.lit(params).cast("string"))
    return rows.select(conv.symbolic_answer(F.lit(category), F.col("p"), mode)).first()[0]


REPLY = document([message("customer", 0), message("agent", 16)], ["Urgent"], "Email")


@pytest.mark.parametrize(
    "category, params, expected",
    [
        ("SYMBOLIC_TIME", '{"threshold": 16, "unit": "min", "operator": "<="}', "yes"),
        ("SYMBOLIC_TIME", '{"threshold": 16, "unit": "min", "operator": "lt"}', "no"),
        ("SYMBOLIC_TIME", '{"threshold": 960, "unit": "sec", "operator": "eq"}', "yes"),
        ("SYMBOLIC_TIME", '{"threshold": 16.005, "operator": "=="}', "yes"),
        ("SYMBOLIC_TIME", '{"unit": "min"}', "invalid"),
        ("SYMBOLIC_TIME", None, "invalid"),
        ("SYMBOLIC_COUNT", '{"threshold": 2, "operator": "gte"}', "yes"),
        ("SYMBOLIC_COUNT", '{"threshold": 2, "operator": ">"}', "no"),
        ("SYMBOLIC_METADATA", '{"subtype": "tag", "value": "URGENT"}', "yes"),
        ("SYMBOLIC_METADATA", '{"value": "urgent"}', "yes"),
        ("SYMBOLIC_METADATA", '{"subtype": "channel", "value": "email"}', "yes"),
        ("SYMBOLIC_METADATA", '{"subtype": "notes", "value": null}', "no"),
        ("SYMBOLIC_METADATA", '{"subtype": "other"}', "no"),
        ("SEMANTIC", '{"subtype": "tag"}', "no"),
    ],
)
def test_production_dispatch(spark, category, params, expected):
    assert answers(spark, REPLY, category, params) == expected


def test_units_differ_between_tables(spark):
    hr = '{"threshold": 1, "unit": "hr", "operator": "<"}'
    assert answers(spark, REPLY, "SYMBOLIC_TIME", hr) == "no"
    assert answers(spark, REPLY, "SYMBOLIC_TIME", hr, "rescore") == "yes"
    exact = '{"subtype": "tag", "value": "urgent"}'
    assert answers(spark, REPLY, "SYMBOLIC_METADATA", exact, "independent") == "no"


@pytest.mark.parametrize(
    "category, params, mode",
    [
        ("SYMBOLIC_TIME", '{"threshold": 1, "unit": "min"}', "production"),
        ("SYMBOLIC_COUNT", '{"threshold": 1, "operator": "="}', "production"),
        ("SYMBOLIC_TIME", '{"threshold": 1, "unit": "weeks", "operator": "<"}', "independent"),
        ("SEMANTIC", "{}", "rescore"),
    ],
)
def test_errors_are_errors(spark, category, params, mode):
    with pytest.raises(PySparkException):
        answers(spark, REPLY, category, params, mode)


def test_missing_visibility_reads_public_in_the_independent_form(spark):
    bare = json.dumps({"messages": [{"role": "customer", "text": "t", "timestamp": "2024-01-01T10:00:00.5"}]})
    row = features(spark, [bare], independent=True).first()
    assert (row.n_public, row.channel, row.tags) == (1, "", [])


def test_regressions_of_polarity_and_operator(spark):
    def check(actual, op, limit):
        value = checks.holds(F.lit(actual), F.lit(op), F.lit(limit))
        return spark.range(1).select(checks.yes_no(value)).first()[0]

    assert check(32.0 * 60, ">", 16.0) == "yes"
    assert check(28.0, ">", 14.0) == "yes"
    assert check(19.0, "<", 18.0) == "no"
    assert check(13.0, "<", 17.0) == "yes"


def test_stream_scores_like_a_table(spark, tmp_path):
    rows = [
        ("p", "SYMBOLIC_TIME", REPLY, i, '{"threshold": %d, "operator": "<="}' % limit)
        for i, limit in enumerate([10, 16, 20])
    ]
    pairs = spark.createDataFrame(
        rows, "prompt string, category string, conversation_json string, conversation_idx bigint, params string"
    )
    pairs.repartition(2).write.json(str(tmp_path / "in"))
    stream = scoring.scored(scoring.read_pairs(spark, str(tmp_path / "in"), 1))
    run = (
        stream.select("conversation_idx", "answer")
        .writeStream.format("memory")
        .queryName("scored")
        .option("checkpointLocation", str(tmp_path / "state"))
        .start()
    )
    run.processAllAvailable()
    run.stop()
    got = sorted(tuple(r) for r in spark.table("scored").collect())
    assert got == [(0, "no"), (1, "yes"), (2, "yes")]
    again = scoring.scored(pairs).select("conversation_idx", "answer").collect()
    assert sorted(tuple(r) for r in again) == got


def test_offsets_are_honoured_and_bad_rows_do_not_end_the_job(spark):
    texts = ["2024-01-02T10:00:00+02:00", "2024-01-02 10:00:00Z", "2024-01-02 08:00:00.5", "2024-01-02T03:00:00-0500", "2024-01-02", "soon", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [str(r[0]) for r in rows.orderBy("id").select(conv.parse_timestamp(F.col("t"))).collect()]
    assert got == [
        "2024-01-02 08:00:00", "2024-01-02 10:00:00", "2024-01-02 08:00:00.500000", "2024-01-02 08:00:00",
        "2024-01-02 00:00:00", "None", "None",
    ]
    assert [r.t for r in conv.unreadable_timestamps(rows, "t").collect()] == ["soon"]
    bad = spark.createDataFrame(
        [("SYMBOLIC_TIME", '{"threshold": 5, "unit": "minutes"}', 3.0), ("SYMBOLIC_TIME", '{"threshold": 5, "operator": "<"}', 3.0)],
        "category string, params string, response_minutes double",
    ).withColumns({"n_public": F.lit(2), "tags": F.array(F.lit("a")), "channel": F.lit("chat"), "has_notes": F.lit(False)})
    c, p, judge = F.col("category"), F.col("params"), F.lit("asked")
    strict = [r[0] for r in bad.select(routing.routed_strict(c, c, p, judge)).collect()]
    assert strict == ["invalid", "yes"]
    deployed = [r[0] for r in bad.select(routing.routed_deployed(c, c, F.lit("within 5 minutes"), p, judge)).collect()]
    assert deployed == ["asked", "yes"]
