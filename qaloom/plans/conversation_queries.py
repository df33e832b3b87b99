"""Queries over conversations: facts, checks, dispatch, agreement, renderings, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions import checks, draws, text
from qaloom.operators import conversations as conv
from qaloom.operators import gates, routing
from qaloom.plans import sql as Q
from qaloom.plans import tables as T
from qaloom.plans.registry import query
from qaloom.sources import readers

_US = "(epoch_us({b}) - epoch_us({a})) / 6e7::DOUBLE"


@query("c1_first_response", f"WITH {Q.FIRST} SELECT conv_id, round(response_minutes, 6) AS response_minutes FROM first_response")
def c1(spark, sf):
    out = conv.first_response_flat(T.event_messages(spark, sf))
    return out.select("conv_id", F.round("response_minutes", 6).alias("response_minutes"))


_INDEPENDENT = f"""{Q.MESSAGES},
independent AS (
  SELECT c.conv_id, {_US.format(a='c.ts', b='a.ts')} AS minutes
  FROM (SELECT conv_id, ts FROM messages WHERE role = 'customer' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq) = 1) c
  JOIN (SELECT conv_id, ts FROM messages WHERE role = 'agent' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq) = 1) a USING (conv_id))"""


@query(
    "c2_first_response_independent",
    f"""WITH {_INDEPENDENT} SELECT conv_id, round(minutes, 6) AS method_a, round(minutes, 6) AS method_b,
    round(minutes, 6) AS method_c, true AS agreed FROM (SELECT DISTINCT conv_id FROM messages) LEFT JOIN independent USING (conv_id)""",
)
def c2(spark, sf):
    m = T.event_messages(spark, sf)
    a = conv.first_response_independent_flat(m).withColumnRenamed("response_minutes", "method_a")
    b = conv.first_response_independent_joined(m).withColumnRenamed("response_minutes", "method_b")
    stamped = m.withColumnRenamed("ts", "timestamp").withColumn("channel", F.lit("chat"))
    nested = conv.nest_messages(stamped).withColumn("c", F.struct("messages"))
    c = nested.select("conv_id", conv.first_response_minutes_independent(F.col("c")).alias("method_c"))
    out = c.join(a, "conv_id", "left").join(b, "conv_id", "left")
    methods = ["method_a", "method_b", "method_c"]
    agreed = conv.consensus(out, methods, "method_a")
    return agreed.select("conv_id", *[F.round(x, 6).alias(x) for x in methods], "agreed")


@query(
    "c3_response_check",
    f"""WITH {Q.FIRST} SELECT conv_id, {", ".join(
        f"CASE WHEN coalesce(response_minutes {op} {limit}, false) THEN 'yes' ELSE 'no' END AS {name}"
        for name, op, limit in [("under_2_hours", "<=", "120"), ("over_1_day", ">", "1440"), ("under_90_minutes", "<", "90")])}
    FROM (SELECT DISTINCT conv_id FROM messages) LEFT JOIN first_response USING (conv_id)""",
)
def c3(spark, sf):
    rows = conv.flat_features(T.event_messages(spark, sf))

    def check(limit, unit, op):
        minutes = checks.threshold_minutes(F.lit(limit), F.lit(unit))
        return conv.check_time(F.col("response_minutes"), minutes, checks.canonical_operator(F.lit(op)))

    return rows.select(
        "conv_id",
        check(2, "hours", "lte").alias("under_2_hours"),
        check(1, "day", ">").alias("over_1_day"),
        check(90, "min", "lt").alias("under_90_minutes"),
    )


_TURNS = """
turns AS (SELECT conv_id, turn, role <> 'system' AS is_public,
  CASE WHEN role = 'user' THEN 'customer' ELSE 'agent' END AS role, text FROM conversations)"""


@query(
    "c4_message_counts",
    f"""WITH {_TURNS} SELECT conv_id, count(*) FILTER (WHERE is_public) AS n_public, count(*) AS n_all FROM turns GROUP BY conv_id""",
)
def c4(spark, sf):
    return (
        T.turn_messages(spark, sf)
        .groupBy("conv_id")
        .agg(F.count_if("is_public").alias("n_public"), F.count(F.lit(1)).alias("n_all"))
    )


@query(
    "c5_count_check",
    f"""WITH {_TURNS} SELECT conv_id, CASE WHEN n < 5 THEN 'yes' ELSE 'no' END AS under_5, CASE WHEN n = 4 THEN 'yes' ELSE 'no' END AS exactly_4
    FROM (SELECT conv_id, count(*) FILTER (WHERE is_public) AS n FROM turns GROUP BY conv_id)""",
)
def c5(spark, sf):
    def check(limit, op):
        return conv.check_count(F.col("n_public"), F.lit(limit), checks.canonical_operator(F.lit(op)))

    return c4(spark, sf).select("conv_id", check(5, "<").alias("under_5"), check(4, "eq").alias("exactly_4"))


@query(
    "c6_tag_present",
    f"""WITH {Q.FEATURES} SELECT conv_id, CASE WHEN list_contains(tags, 'purchase') THEN 'yes' ELSE 'no' END AS any_case,
    'no' AS exact_case FROM features""",
)
def c6(spark, sf):
    rows = T.conversation_features(spark, sf)
    tags, value = F.col("tags"), F.lit("Purchase")
    return rows.select(
        "conv_id",
        conv.check_tag(tags, value).alias("any_case"),
        conv.check_tag(tags, value, case_sensitive=True).alias("exact_case"),
    )


@query(
    "c7_channel",
    """SELECT o_orderkey, CASE WHEN lower(o_orderpriority) = '1-urgent' THEN 'yes' ELSE 'no' END AS any_case,
    CASE WHEN o_orderpriority = '1-urgent' THEN 'yes' ELSE 'no' END AS exact_case FROM orders""",
)
def c7(spark, sf):
    channel, value = F.col("o_orderpriority"), F.lit("1-urgent")
    return T.table(spark, sf, "orders").select(
        "o_orderkey",
        conv.check_channel(channel, value).alias("any_case"),
        conv.check_channel(channel, value, case_sensitive=True).alias("exact_case"),
    )


@query(
    "c8_private_notes",
    f"WITH {_TURNS} SELECT conv_id, CASE WHEN bool_or(NOT is_public) THEN 'yes' ELSE 'no' END AS notes FROM turns GROUP BY conv_id",
)
def c8(spark, sf):
    rows = T.turn_messages(spark, sf).groupBy("conv_id")
    return rows.agg(checks.yes_no(F.bool_or(~F.col("is_public"))).alias("notes"))


@query("c9_resolution_time", f"WITH {Q.FEATURES} SELECT conv_id, resolution_minutes FROM features")
def c9(spark, sf):
    return conv.flat_features(T.event_messages(spark, sf)).select("conv_id", "resolution_minutes")


@query(
    "c10_dispatch",
    f"""WITH {Q.PAIRS} SELECT id, category, {Q.answer_of('category', days=False)} AS production, truth AS rescored
    FROM pairs WHERE starts_with(category, 'SYMBOLIC')""",
)
def c10(spark, sf):
    rows = T.pairs(spark, sf).where(F.col("category").startswith("SYMBOLIC"))
    category, params = F.col("category"), F.col("params")
    return rows.select(
        "id",
        "category",
        conv.symbolic_answer(category, params).alias("production"),
        conv.symbolic_answer(category, params, "rescore").alias("rescored"),
    )


@query(
    "c11_dispatch_strict",
    f"""WITH {Q.PAIRS} SELECT id, CASE WHEN category = 'SYMBOLIC_METADATA' AND json_extract_string(params, '$.subtype') = 'tag'
      THEN CASE WHEN list_contains(tags, json_extract_string(params, '$.value')) THEN 'yes' ELSE 'no' END
      WHEN category = 'UNSUPPORTED' THEN 'reject' ELSE truth END AS independent
    FROM pairs WHERE starts_with(category, 'SYMBOLIC') OR category = 'UNSUPPORTED'""",
)
def c11(spark, sf):
    rows = T.pairs(spark, sf).where(F.col("category").startswith("SYMBOLIC") | (F.col("category") == "UNSUPPORTED"))
    answer = conv.symbolic_answer(F.col("category"), F.col("params"), "independent")
    return rows.select("id", answer.alias("independent"))


@query(
    "c12_truth_mismatches",
    f"WITH {Q.PAIRS} SELECT id, truth, judge_answer FROM pairs WHERE starts_with(category, 'SYMBOLIC') AND judge_answer IS DISTINCT FROM truth",
)
def c12(spark, sf):
    rows = T.pairs(spark, sf).where(F.col("category").startswith("SYMBOLIC"))
    return conv.truth_mismatches(rows, "truth", "judge_answer").select("id", "truth", "judge_answer")


@query(
    "c13_answer_variance",
    f"WITH {Q.RUNS} SELECT model, idx, count(*) AS n_runs, count(DISTINCT answer) AS n_answers FROM runs GROUP BY ALL",
)
def c13(spark, sf):
    return conv.answer_variance(T.repeat_runs(spark, sf), ["model", "idx"], "answer")


_METHODS = ["judge", "routed", "strict", "deployed"]


@query(
    "c14_agreement_table",
    f"""WITH {Q.ROUTED}, long AS ({" UNION ALL ".join(
        f"SELECT '{m}' AS method, category, {m}_answer AS answer, truth FROM routed_pairs" for m in _METHODS)})
    SELECT method, coalesce(category, 'ALL') AS category, count(*) AS n, count(*) FILTER (WHERE answer = truth) AS n_agree,
      round(avg(CAST(answer = truth AS INTEGER)), 6) AS agreement FROM long GROUP BY GROUPING SETS ((method, category), (method))""",
)
def c14(spark, sf):
    rows = T.routed_pairs(spark, sf).select(
        "category", "truth", *[F.col(f"{m}_answer").alias(m) for m in _METHODS]
    )
    out = conv.agreement_table(rows, _METHODS, "truth", "category")
    return out.withColumn("agreement", F.round("agreement", 6))


@query(
    "c15_cross_agreement",
    f"""WITH {Q.ROUTED} {" UNION ALL ".join(
        f"SELECT '{a}' AS method_a, '{b}' AS method_b, count(*) FILTER (WHERE {a}_answer = {b}_answer) AS n_same, count(*) AS n, round(avg(CAST({a}_answer = {b}_answer AS INTEGER)), 6) AS agreement FROM routed_pairs"
        for i, a in enumerate(_METHODS) for b in _METHODS[i:])}""",
)
def c15(spark, sf):
    rows = T.routed_pairs(spark, sf).select(*[F.col(f"{m}_answer").alias(m) for m in _METHODS])
    return conv.cross_agreement(rows, _METHODS).withColumn("agreement", F.round("agreement", 6))


@query(
    "c16_consensus",
    f"""WITH {Q.ROUTED} SELECT id, judge_answer = routed_answer AND routed_answer = strict_answer AND strict_answer = deployed_answer AS agreed,
      judge_answer = routed_answer AND routed_answer = strict_answer AND strict_answer = deployed_answer AND deployed_answer = truth AS agreed_with_truth
    FROM routed_pairs""",
)
def c16(spark, sf):
    methods = [f"{m}_answer" for m in _METHODS]
    return conv.consensus(T.routed_pairs(spark, sf), methods, "truth").select("id", "agreed", "agreed_with_truth")


@query(
    "c17_truth_balance",
    f"""WITH {Q.PAIRS} SELECT category, count(*) FILTER (WHERE truth = 'yes') AS yes, count(*) FILTER (WHERE truth = 'no') AS no,
    count(*) FILTER (WHERE truth = 'reject') AS reject FROM pairs GROUP BY category""",
)
def c17(spark, sf):
    from qaloom.operators.metrics import crosstab

    return crosstab(T.pairs(spark, sf), "category", "truth", ["yes", "no", "reject"])


# ---- renderings, documents, keys ------------------------------------------------------------

_STAMP = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn), '%Y-%m-%d %H:%M:%S')"
_LINE = f"'[' || {_STAMP} || '] ' || upper(role) || CASE WHEN is_public THEN '' ELSE ' [INTERNAL NOTE]' END || ': ' || text"


def _stamped_turns(spark, sf):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    stamp = F.timestamp_add("MINUTE", F.col("seq").cast("int"), start)
    return T.turn_messages(spark, sf).withColumns({"timestamp": stamp, "channel": F.lit("chat")})


@query("b16_transcript_lines", f"WITH {_TURNS} SELECT conv_id, turn AS seq, {_LINE} AS line FROM turns")
def b16_lines(spark, sf):
    line = text.message_line(F.col("timestamp"), F.col("role"), F.col("is_public"), F.col("text"))
    return _stamped_turns(spark, sf).select("conv_id", "seq", line.alias("line"))


def _nested(spark, sf):
    rows = conv.nest_messages(_stamped_turns(spark, sf))
    c = F.struct(
        "messages",
        F.array(F.lit("open"), F.lit("late")).alias("tags"),
        F.lit("chat").alias("channel"),
        F.lit(None).cast("double").alias("resolution_time_minutes"),
    )
    return rows.select("conv_id", c.alias("c"))


_SCRIPT = f"""{_TURNS},
scripts AS (SELECT conv_id, 'Channel: chat | Tags: open, late' || chr(10) || chr(10) || string_agg({_LINE}, chr(10) ORDER BY turn) AS transcript
  FROM turns GROUP BY conv_id)"""


@query("b16_transcript", f"WITH {_SCRIPT} SELECT conv_id, transcript FROM scripts")
def b16(spark, sf):
    return _nested(spark, sf).select("conv_id", text.transcript(F.col("c")).alias("transcript"))


def _request_sql(kind: str) -> str:
    system, opening, middle, question = text.REQUEST_FRAMES[kind]
    return f"{Q.text(opening)} || transcript || {Q.text(middle)} || item || {Q.text(question)}"


_JUDGED = f"""{_SCRIPT},
judged AS (SELECT conv_id, transcript, coalesce(b.text, '') AS item FROM scripts LEFT JOIN benchmark b ON b.item_id = conv_id % (SELECT max(item_id) + 1 FROM benchmark))"""


@query(
    "b17_judge_requests",
    f"""WITH {_JUDGED} SELECT conv_id, {", ".join(f"md5({_request_sql(k)}) AS {k}_request" for k in text.REQUEST_FRAMES)},
    'baseline_binary_m_' || substr(md5(item || ':' || transcript), 1, 12) AS short_key,
    'm:baseline_binary:' || substr(sha256('m|' || item || '|' || transcript || '|baseline_binary'), 1, 20) AS long_key FROM judged""",
)
def b17(spark, sf):
    """One request per conversation and frame: the items are dealt to all conversations in turn."""
    items = T.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    last = items.agg((F.max("item_id") + 1).alias("__items"))  # one row
    rows = b16(spark, sf).join(F.broadcast(last)).withColumn("item_id", F.col("conv_id") % F.col("__items"))
    rows = rows.join(items, "item_id", "left").withColumn("item", F.coalesce("item", F.lit("")))
    script, item = F.col("transcript"), F.col("item")
    requests = [
        F.md5(text.judge_request(kind, script, item)["user"]).alias(f"{kind}_request")
        for kind in text.REQUEST_FRAMES
    ]
    return rows.select(
        "conv_id",
        *requests,
        text.answer_key("baseline_binary", "m", item, script).alias("short_key"),
        text.answer_key_long("baseline_binary", "m", item, script).alias("long_key"),
    )


@query(
    "a6_conversation_json",
    f"""WITH {_TURNS} SELECT conv_id, count(*) AS n_all, count(*) FILTER (WHERE is_public) AS n_public,
    round((max(turn) FILTER (WHERE true) - min(turn))::DOUBLE, 1) AS resolution_minutes, bool_or(NOT is_public) AS has_notes,
    'open,late' AS tags, 'chat' AS channel FROM turns GROUP BY conv_id""",
)
def a6(spark, sf):
    """A7 then A6: serialise, parse back, and read the facts from the parsed form."""
    back = _nested(spark, sf).select(
        "conv_id", conv.parse_conversation(conv.conversation_json(F.col("c"))).alias("c")
    )
    c = F.col("c")
    return back.select(
        "conv_id",
        conv.count_messages(c, public_only=False).cast("bigint").alias("n_all"),
        conv.count_messages(c).cast("bigint").alias("n_public"),
        conv.resolution_minutes(c).alias("resolution_minutes"),
        conv.has_notes(c).alias("has_notes"),
        F.array_join(c["tags"], ",").alias("tags"),
        c["channel"].alias("channel"),
    )


@query(
    "a6_timestamps",
    """SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN CASE WHEN event_id % 4 = 1 THEN epoch_us(ts) ELSE epoch_us(date_trunc('second', ts)) END END AS micros,
    event_id % 50 = 7 AS unreadable FROM events""",
)
def a6_times(spark, sf):
    """Event times written in four forms, one of them with an offset, and some that are no times, read back."""
    e, k = T.table(spark, sf, "events"), F.col("event_id") % 4
    ts = F.col("ts").cast("timestamp_ntz")
    late = ts + F.make_dt_interval(mins=F.lit(150))
    form = (
        F.when(F.col("event_id") % 50 == 7, "at noon")
        .when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(k == 2, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("Z")))
        .otherwise(F.concat(F.date_format(late, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:30")))
    )
    rows = e.select("event_id", form.alias("text"))
    bad = conv.unreadable_timestamps(rows, "text").select("event_id", F.lit(True).alias("__bad"))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), conv.parse_timestamp(F.col("text")))
    return rows.join(bad, "event_id", "left").select("event_id", micros.alias("micros"), F.coalesce("__bad", F.lit(False)).alias("unreadable"))


@query(
    "a9_answer_lookup",
    f"""WITH {Q.PAIRS} SELECT id, judge_answer, judge_tokens, judge_latency_ms FROM pairs""",
)
def a9(spark, sf):
    p = T.pairs(spark, sf)
    key = text.answer_key("baseline_binary", "m", F.col("prompt"), F.col("id").cast("string"))
    keyed = p.select("id", key.alias("cache_key"), "judge_answer", "judge_tokens", "judge_latency_ms")
    stored = keyed.select(
        "cache_key",
        F.col("judge_answer").alias("answer"),
        F.col("judge_tokens").cast("bigint").alias("tokens"),
        F.col("judge_latency_ms").alias("latency_ms"),
    )
    return routing.lookup_answers(keyed.select("id", "cache_key"), stored, "cache_key").drop("cache_key")


@query(
    "a10_latest_snapshot",
    "SELECT event_id, value FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)",
)
def a10(spark, sf):
    """The newest day of a table that carries its snapshot as a column."""
    events = T.table(spark, sf, "events").withColumn("snapshot", F.col("ts").cast("date"))
    newest = events.agg(F.max("snapshot").alias("snapshot"))
    return events.join(F.broadcast(newest), "snapshot", "left_semi").select("event_id", "value")


def _quarter(i: int) -> str:
    return f"CAST(sum(CAST('0x' || substr(md5(text), {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)"


@query(
    "a11_fingerprint",
    f"SELECT substr(md5(concat_ws(':', count(text)::VARCHAR, {', '.join(_quarter(i) for i in range(4))})), 1, 8) AS fingerprint FROM documents",
)
def a11(spark, sf):
    return readers.fingerprint(T.table(spark, sf, "documents"), "text")


_UNITS = ["seconds", "minutes", "hours", "sec", "min", "hrs", "secs", "hr", "day"]


@query(
    "b11_unit_tables",
    f"""SELECT event_id, u AS unit, round(CASE WHEN u IN ('seconds', 'sec') THEN value / 60 WHEN u IN ('hours', 'hrs') THEN value * 60 ELSE value END, 6) AS lenient,
    round(CASE WHEN u IN ('seconds', 'sec', 'secs') THEN value / 60 WHEN u IN ('hours', 'hrs', 'hr') THEN value * 60 WHEN u = 'day' THEN value * 1440 ELSE value END, 6) AS extended,
    round(CASE WHEN u IN ('seconds', 'sec', 'secs') THEN value / 60 WHEN u IN ('hours', 'hrs', 'hr') THEN value * 60 WHEN u = 'day' THEN value * 1440 ELSE value END, 6) AS strict
    FROM (SELECT event_id, value, {Q.pick(_UNITS, 'unit', 'event_id')} AS u FROM events)""",
)
def b11(spark, sf):
    rows = T.table(spark, sf, "events").withColumn("unit", draws.pick(_UNITS, "unit", F.col("event_id")))
    return rows.select(
        "event_id",
        "unit",
        *[
            F.round(checks.threshold_minutes(F.col("value"), F.col("unit"), t), 6).alias(t)
            for t in ["lenient", "extended", "strict"]
        ],
    )


_OPS = ["<", "lt", "<=", "lte", "le", ">", "gt", ">=", "gte", "ge", "==", "eq", "="]


@query(
    "b12_b13_comparisons",
    f"""SELECT event_id, op, CASE WHEN op IN ('<', 'lt') THEN '<' WHEN op IN ('<=', 'lte', 'le') THEN '<=' WHEN op IN ('>', 'gt') THEN '>'
      WHEN op IN ('>=', 'gte', 'ge') THEN '>=' WHEN op IN ('==', 'eq') THEN '==' END AS canonical,
    CASE WHEN CASE WHEN op IN ('<', 'lt') THEN value < 40 WHEN op IN ('<=', 'lte', 'le') THEN value <= 40 WHEN op IN ('>', 'gt') THEN value > 40
      WHEN op IN ('>=', 'gte', 'ge') THEN value >= 40 WHEN op IN ('==', 'eq') THEN abs(value - 40) < 0.01 ELSE false END THEN 'yes' ELSE 'no' END AS answer
    FROM (SELECT event_id, value, {Q.pick(_OPS, 'op', 'event_id')} AS op FROM events)""",
)
def b12_b13(spark, sf):
    rows = T.table(spark, sf, "events").withColumn("op", draws.pick(_OPS, "op", F.col("event_id")))
    canonical = checks.canonical_operator(F.col("op"), on_error="null")
    answer = conv.check_time(F.col("value"), F.lit(40.0), canonical)
    return rows.select("event_id", "op", canonical.alias("canonical"), answer.alias("answer"))


@query(
    "v4_truth_gates",
    f"""WITH {Q.ROUTED} SELECT 'V4_judge' AS rule, count(*) AS n_violations FROM routed_pairs WHERE starts_with(category, 'SYMBOLIC') AND judge_answer IS DISTINCT FROM truth HAVING count(*) > 0
    UNION ALL SELECT 'V4_deployed', count(*) FROM routed_pairs WHERE starts_with(category, 'SYMBOLIC') AND deployed_answer IS DISTINCT FROM truth HAVING count(*) > 0""",
)
def v4(spark, sf):
    rows = T.routed_pairs(spark, sf).where(F.col("category").startswith("SYMBOLIC"))
    again = conv.symbolic_answer(F.col("category"), F.col("params"), "rescore")
    rows = rows.withColumn("recomputed", again)
    found = gates.answers_agree(
        rows, "id", "truth", {"judge": "judge_answer", "deployed": "deployed_answer", "recomputed": "recomputed"}
    )
    return gates.rule_counts(found)
