"""Facts about conversations and the yes/no checks built on them.

Two layouts are supported. *Nested*: one row per conversation with an array of messages; every
fact is a column expression and nothing is shuffled. *Flat*: one row per message; every fact is a
mergeable aggregate (``min_by``, counts), so a conversation that holds a third of all messages is
pre-aggregated where it is read and is never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom import schemas
from qaloom.functions import checks
from qaloom.functions.staging import let
from qaloom.session import lookup


def minutes_between(start: Column, end: Column) -> Column:
    """Elapsed minutes as DOUBLE; works for both timestamp types."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(6e7)


_OFFSET = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def parse_timestamp(text: Column) -> Column:
    """ISO text with "T" or a space, with or without fractions; null when unreadable.

    An offset is honoured: the result is the moment in UTC. Text without one is taken as UTC.
    """
    trimmed = F.trim(text)
    clock = F.regexp_replace(trimmed, _OFFSET, "").try_cast("timestamp_ntz")
    # A date alone ends in digits that look like an offset; only what follows a clock time is one.
    offset = F.when(trimmed.rlike(r":\d{2}(?:\.\d+)?" + _OFFSET), F.regexp_extract(trimmed, r"([+-])(\d{2}):?(\d{2})$", 0))
    digits = F.regexp_replace(F.substring(offset, 2, 5), ":", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    east = F.when(offset.startswith("-"), -minutes).otherwise(minutes)
    moved = clock - F.make_dt_interval(mins=F.coalesce(east, F.lit(0)))
    return F.when(offset.isNull(), trimmed.try_cast("timestamp_ntz")).otherwise(moved)


def unreadable_timestamps(df: DataFrame, text: str) -> DataFrame:
    """Rows whose timestamp text is given but cannot be read; empty means all times are known."""
    return df.where(F.col(text).isNotNull() & parse_timestamp(F.col(text)).isNull())


def parse_conversation(text: Column, independent: bool = False) -> Column:
    """The conversation struct of a JSON document, timestamps parsed.

    The production form takes visibility as given; the independent form reads a missing
    visibility as public. A missing message channel is the conversation's in both.
    """
    raw = F.from_json(text, schemas.CONVERSATION)
    channel = F.coalesce(raw["channel"], F.lit("" if independent else "chat"))
    messages = F.transform(
        raw["messages"],
        lambda m: F.struct(
            m["role"].alias("role"),
            m["text"].alias("text"),
            parse_timestamp(m["timestamp"]).alias("timestamp"),
            (F.coalesce(m["is_public"], F.lit(True)) if independent else m["is_public"]).alias(
                "is_public"
            ),
            F.coalesce(m["channel"], channel).alias("channel"),
        ),
    )
    return F.struct(
        messages.alias("messages"),
        F.coalesce(raw["tags"], F.array().cast("array<string>")).alias("tags"),
        channel.alias("channel"),
        raw["resolution_time_minutes"].alias("resolution_time_minutes"),
    )


def conversation_json(conversation: Column) -> Column:
    """A conversation as JSON, timestamps with a space between date and time."""
    return F.to_json(
        conversation,
        {
            "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
            "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
            "ignoreNullFields": "false",
        },
    )


# ---- nested layout -------------------------------------------------------------------------


def first_response_minutes(conversation: Column) -> Column:
    """First public customer message to the next public agent message that is later."""
    asked = F.get(
        F.filter(
            conversation["messages"], lambda m: (m["role"] == "customer") & m["is_public"]
        ),
        F.lit(0),
    )["timestamp"]
    answered = F.get(
        F.filter(
            conversation["messages"],
            lambda m: (m["role"] == "agent") & m["is_public"] & (m["timestamp"] > asked),
        ),
        F.lit(0),
    )["timestamp"]
    return minutes_between(asked, answered)


def first_response_minutes_independent(conversation: Column) -> Column:
    """C2, nested form: first customer to first agent message, whatever their order."""

    def first(role: str) -> Column:
        return F.get(F.filter(conversation["messages"], lambda m: m["role"] == role), F.lit(0))

    return minutes_between(first("customer")["timestamp"], first("agent")["timestamp"])


def count_messages(conversation: Column, public_only: bool = True) -> Column:
    """C4: number of (public) messages."""
    messages = conversation["messages"]
    return F.size(F.filter(messages, lambda m: m["is_public"]) if public_only else messages)


def has_notes(conversation: Column) -> Column:
    """Any message that is not public."""
    return F.exists(conversation["messages"], lambda m: ~m["is_public"])


def resolution_minutes(conversation: Column) -> Column:
    """Last message minus first, minutes, one decimal."""
    stamps = F.transform(conversation["messages"], lambda m: m["timestamp"])
    return F.round(minutes_between(F.array_min(stamps), F.array_max(stamps)), 1)


def nested_features(df: DataFrame, conversation: str, independent: bool = False) -> DataFrame:
    """All facts the dispatch needs, from a parsed conversation column; no shuffle."""
    c = F.col(conversation)
    minutes = first_response_minutes_independent(c) if independent else first_response_minutes(c)
    return df.withColumns(
        {
            "response_minutes": minutes,
            "n_public": count_messages(c).cast("bigint"),
            "tags": c["tags"],
            "channel": c["channel"],
            "has_notes": has_notes(c),
        }
    )


# ---- flat layout ---------------------------------------------------------------------------


def first_response_flat(
    messages: DataFrame, conv: str = "conv_id", seq: str = "seq", ts: str = "ts"
) -> DataFrame:
    """C1 on one row per message: (conv, asked_at, answered_at, response_minutes).

    "First" means first in sequence. Both steps are mergeable aggregates; the join in between
    carries one narrow row per conversation, written once and broadcast only if small, and only
    later public agent messages pass it.
    """
    public = messages.where(F.col("is_public")).select(conv, seq, ts, "role")
    asked = lookup(
        public.where(F.col("role") == "customer")
        .groupBy(conv)
        .agg(F.min_by(ts, seq).alias("asked_at"))
    )
    answered = (
        public.where(F.col("role") == "agent")
        .join(asked, conv)
        .where(F.col(ts) > F.col("asked_at"))
        .groupBy(conv)
        .agg(F.min_by(ts, seq).alias("answered_at"))
    )
    return asked.join(answered, conv, "left").withColumn(
        "response_minutes", minutes_between(F.col("asked_at"), F.col("answered_at"))
    )


def first_response_independent_flat(
    messages: DataFrame, conv: str = "conv_id", seq: str = "seq", ts: str = "ts"
) -> DataFrame:
    """C2 as one aggregate: first customer and first agent message of any visibility."""

    def first(role: str) -> Column:
        return F.min_by(F.when(F.col("role") == role, F.col(ts)), F.when(F.col("role") == role, F.col(seq)))

    return messages.groupBy(conv).agg(
        minutes_between(first("customer"), first("agent")).alias("response_minutes")
    )


def first_response_independent_joined(
    messages: DataFrame, conv: str = "conv_id", seq: str = "seq", ts: str = "ts"
) -> DataFrame:
    """C2 a second way: the smallest (sequence, time) pair per role, the two roles joined."""

    def side(role: str, name: str) -> DataFrame:
        picked = messages.where(F.col("role") == role).groupBy(conv)
        return picked.agg(F.min(F.struct(seq, ts)).alias(name))

    both = side("customer", "asked").join(side("agent", "answered"), conv, "full")
    return both.select(
        conv,
        minutes_between(F.col(f"asked.{ts}"), F.col(f"answered.{ts}")).alias("response_minutes"),
    )


def flat_features(
    messages: DataFrame, conv: str = "conv_id", seq: str = "seq", ts: str = "ts", tag: str | None = None
) -> DataFrame:
    """C1, C4, C8, C9 and the tag set of every conversation in the flat layout.

    ``tag`` names a low-cardinality column whose distinct values are the conversation's tags.
    """
    facts = [
        F.count_if("is_public").alias("n_public"),
        F.count(F.lit(1)).alias("n_messages"),
        F.bool_or(~F.col("is_public")).alias("has_notes"),
        F.round(minutes_between(F.min(ts), F.max(ts)), 1).alias("resolution_minutes"),
    ]
    if tag is not None:
        facts.append(F.sort_array(F.collect_set(tag)).alias("tags"))
    whole = messages.groupBy(conv).agg(*facts)
    first = first_response_flat(messages, conv, seq, ts).select(conv, "response_minutes")
    return whole.join(first, conv, "left")


def nest_messages(messages: DataFrame, conv: str = "conv_id", seq: str = "seq") -> DataFrame:
    """Flat to nested: (conv, messages), each conversation in sequence order.

    A nested conversation is one row by definition, so this is for conversations that fit a row;
    the flat operators above need no such bound.
    """
    fields = ["role", "text", "timestamp", "is_public", "channel"]
    ordered = F.sort_array(F.collect_list(F.struct(seq, *fields)))
    return messages.groupBy(conv).agg(
        F.transform(ordered, lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias("messages")
    )


# ---- checks and dispatch -------------------------------------------------------------------


def check_time(minutes: Column, threshold: Column, operator: Column, equality: str = "minutes") -> Column:
    """No response time means "no"."""
    return checks.yes_no(checks.holds(minutes, operator, threshold, equality))


def check_count(n: Column, threshold: Column, operator: Column, equality: str = "exact") -> Column:
    """C5."""
    return checks.yes_no(checks.holds(n, operator, threshold, equality))


def check_tag(tags: Column, value: Column, case_sensitive: bool = False) -> Column:
    """C6."""
    if case_sensitive:
        return checks.yes_no(F.array_contains(tags, value))
    return checks.yes_no(F.array_contains(F.transform(tags, F.lower), F.lower(value)))


def check_channel(channel: Column, value: Column, case_sensitive: bool = False) -> Column:
    """C7."""
    if case_sensitive:
        return checks.yes_no(channel == value)
    return checks.yes_no(F.lower(channel) == F.lower(value))


def symbolic_answer(category: Column, params: Column, mode: str = "production", on_error: str = "raise") -> Column:
    """The exact answer of a symbolic prompt over the feature columns of its conversation.

    Reads the columns ``response_minutes``, ``n_public``, ``tags``, ``channel`` and ``has_notes``.
    Modes: "production" (lenient units, case ignored, missing params read "invalid"), "rescore"
    (units with days, operator and category required) and "independent" (strict units, exact
    case). A TIME or COUNT prompt with a threshold but no usable operator is an error in all, and so is
    an unknown category outside "production"; with ``on_error="null"`` such a row answers null.
    """
    units, equality, exact_case = {
        "production": ("lenient", ("minutes", "exact"), False),
        "rescore": ("extended", ("minutes", "exact"), False),
        "independent": ("strict", ("relative", "relative"), True),
    }[mode]

    def answer(x: Column) -> Column:
        kind, p, operator = x["kind"], x["p"], x["op"]
        timed = check_time(
            F.col("response_minutes"),
            checks.threshold_minutes(p["threshold"], p["unit"], units),
            operator,
            equality[0],
        )
        counted = check_count(F.col("n_public"), p["threshold"].cast("bigint"), operator, equality[1])
        value = F.coalesce(p["value"], F.lit(""))
        subtype = F.coalesce(p["subtype"], F.lit("tag"))
        meta = (
            F.when(subtype == "tag", check_tag(F.col("tags"), value, exact_case))
            .when(subtype == "channel", check_channel(F.col("channel"), value, exact_case))
            .when(subtype == "notes", checks.yes_no(F.col("has_notes")))
        )
        message = F.concat(F.lit("not a symbolic category: "), kind)
        unknown = F.lit(None).cast("string") if on_error == "null" else F.raise_error(message).cast("string")
        if on_error == "null":
            # No operator, no answer; the checks alone would read "no".
            usable = operator.isNotNull() & p["threshold"].try_cast("double").isNotNull()
            timed, counted = F.when(usable, timed), F.when(usable, counted)
        if mode == "production":
            return (
                F.when(~x["given"] | x["bare"], "invalid")
                .when(kind == "SYMBOLIC_TIME", timed)
                .when(kind == "SYMBOLIC_COUNT", counted)
                .when(kind == "SYMBOLIC_METADATA", F.coalesce(meta, F.lit("no")))
                .otherwise("no")
            )
        out = (
            F.when(kind == "SYMBOLIC_TIME", timed)
            .when(kind == "SYMBOLIC_COUNT", counted)
            .when(kind == "SYMBOLIC_METADATA", F.coalesce(meta, unknown))
        )
        if mode == "independent":
            out = out.when(kind == "UNSUPPORTED", "reject")
        return out.otherwise(unknown)

    def with_operator(x: Column) -> Column:
        p, ruled = x["p"], x["kind"].isin("SYMBOLIC_TIME", "SYMBOLIC_COUNT")
        bare = ruled & (p.isNull() | p["threshold"].isNull())
        spelled = p["operator"]
        if mode == "independent":
            spelled = F.when(F.trim(spelled) == "=", "==").otherwise(F.trim(spelled))
        operator = F.when(ruled & ~(bare & F.lit(mode == "production")), checks.canonical_operator(spelled, on_error))
        return F.struct(
            x["kind"].alias("kind"),
            p.alias("p"),
            x["given"].alias("given"),
            bare.alias("bare"),
            operator.alias("op"),
        )

    parsed = F.struct(
        category.alias("kind"),
        F.from_json(params, schemas.PARAMS).alias("p"),
        params.isNotNull().alias("given"),
    )
    return let(let(parsed, with_operator), answer)


def truth_mismatches(df: DataFrame, stored: str, recomputed: str) -> DataFrame:
    """Rows whose stored answer is not the recomputed one; empty means verified."""
    return df.where(~F.col(stored).eqNullSafe(F.col(recomputed)))


def answer_variance(df: DataFrame, key: list[str], answer: str) -> DataFrame:
    """Distinct answers per key over repeated evaluations; 1 everywhere means deterministic."""
    return (
        df.groupBy(*key, answer)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*key)
        .agg(F.sum("n").alias("n_runs"), F.count(answer).alias("n_answers"))
    )


def agreement_table(df: DataFrame, methods: list[str], truth: str, category: str) -> DataFrame:
    """Agreement of each method with the truth, per category and over all, in one pass."""
    hits = [F.count_if(F.col(m).eqNullSafe(F.col(truth))).alias(m) for m in methods]
    wide = df.rollup(category).agg(F.count(F.lit(1)).alias("n"), *hits)
    pairs = F.array(
        *[F.struct(F.lit(m).alias("method"), F.col(m).alias("n_agree")) for m in methods]
    )
    return wide.select(
        F.coalesce(category, F.lit("ALL")).alias("category"), "n", F.explode(pairs).alias("h")
    ).select(
        "h.method",
        "category",
        "n",
        "h.n_agree",
        (F.col("h.n_agree") / F.col("n")).alias("agreement"),
    )


def cross_agreement(df: DataFrame, methods: list[str]) -> DataFrame:
    """Share of equal answers for every unordered pair of methods, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(methods) for b in methods[i:]]
    same = [F.count_if(F.col(a).eqNullSafe(F.col(b))).alias(f"{a}|{b}") for a, b in pairs]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *same)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("method_a"),
                F.lit(b).alias("method_b"),
                F.col(f"`{a}|{b}`").alias("n_same"),
            )
            for a, b in pairs
        ]
    )
    return wide.select("n", F.explode(rows).alias("p")).select(
        "p.*", "n", (F.col("p.n_same") / F.col("n")).alias("agreement")
    )


def consensus(df: DataFrame, methods: list[str], truth: str) -> DataFrame:
    """The input with ``agreed`` (all methods equal) and ``agreed_with_truth`` flags."""
    answers = F.array_distinct(F.array(*[F.col(m) for m in methods]))
    with_truth = F.array_distinct(F.array(*[F.col(m) for m in methods], F.col(truth)))
    return df.withColumns(
        {"agreed": F.size(answers) == 1, "agreed_with_truth": F.size(with_truth) == 1}
    )
