"""Text normalisation, answer parsing, keys and renderings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom.functions.staging import let

# Word characters in any script; Java's bare \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"


def collapse_category(category: Column) -> Column:
    """B2: every SEMANTIC_* subcategory becomes SEMANTIC."""
    return F.when(category.startswith("SEMANTIC_"), F.lit("SEMANTIC")).otherwise(category)


def contains_ignoring_case(text: Column, needle: str) -> Column:
    """Substring test that ignores case and treats a missing text as no match."""
    return F.coalesce(F.lower(text).contains(needle.lower()), F.lit(False))


def clean_label(label: Column, case: str = "upper") -> Column:
    """Trimmed label in one case; blank and "NAN" become null."""
    text = F.upper(F.trim(label)) if case == "upper" else F.lower(F.trim(label))
    return F.when(~F.upper(text).isin("", "NAN"), text)


def mask_digits(text: Column) -> Column:
    """Every run of digits becomes one placeholder."""
    return F.regexp_replace(text, r"\d+", "<NUM>")


def template_of(text: Column) -> Column:
    """Lower-cased, digit-masked, single-spaced form used to compare templates."""
    lowered = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(lowered, r"\d+", "<NUM>"), r"\s+", " ")


def style_of(text: Column) -> Column:
    """A question mark anywhere makes a question."""
    return F.when(text.contains("?"), F.lit("question")).otherwise(F.lit("instruction"))


def tokens(text: Column) -> Column:
    """Lower-cased words of any script, with repeats, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def counted(terms: Column) -> Column:
    """The distinct entries of an array with their counts, array<struct<term, tf>>, sorted.

    Sorting brings equal entries together, so a run's length is its count: n log n inside the row,
    and no row per occurrence to shuffle.
    """

    def runs(sorted_terms: Column) -> Column:
        n = F.size(sorted_terms)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(
            places, lambda i: (i == 0) | (F.get(sorted_terms, i) != F.get(sorted_terms, i - 1))
        )
        return let(first, lambda starts: F.transform(starts, lambda p, j: run(sorted_terms, starts, p, j)))

    def run(sorted_terms: Column, starts: Column, p: Column, j: Column) -> Column:
        end = F.coalesce(F.get(starts, j + 1), F.size(sorted_terms))
        return F.struct(F.get(sorted_terms, p).alias("term"), (end - p).cast("bigint").alias("tf"))

    return let(F.sort_array(terms), runs)


def parse_answer(raw: Column, strict: bool = False) -> Column:
    """A judge's reply as yes, no, reject or invalid.

    Whole replies match first. Otherwise the words are looked for as substrings, so "cannot" and
    "know" read as "no", as in the published scoring; ``strict`` accepts whole replies only.
    """
    text = F.regexp_replace(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), r"\.+$", "")
    out = F.when(text.isin("yes", "no", "reject"), text)
    if not strict:
        yes, no = text.contains("yes"), text.contains("no")
        out = (
            out.when(text.contains("reject") & ~yes & ~no, "reject")
            .when(yes & ~no, "yes")
            .when(no & ~yes, "no")
        )
    return out.otherwise(F.lit("invalid"))


def answer_key(role: str, model: str, prompt: Column, conversation: Column) -> Column:
    """Content key of a stored answer, short form."""
    digest = F.substring(F.md5(F.concat_ws(":", prompt, conversation)), 1, 12)
    return F.concat(F.lit(f"{role}_{model}_"), digest)


def answer_key_long(role: str, model: str, prompt: Column, conversation: Column) -> Column:
    """Content key of a stored answer, long form."""
    body = F.concat_ws("|", F.lit(model), prompt, conversation, F.lit(role))
    return F.concat(F.lit(f"{model}:{role}:"), F.substring(F.sha2(body, 256), 1, 20))


def message_line(timestamp: Column, role: Column, is_public: Column, text: Column) -> Column:
    """B16, one line: ``[time] ROLE [INTERNAL NOTE]: text``."""
    note = F.when(is_public, F.lit("")).otherwise(F.lit(" [INTERNAL NOTE]"))
    stamp = F.substring(timestamp.cast("string"), 1, 19)
    return F.concat(F.lit("["), stamp, F.lit("] "), F.upper(role), note, F.lit(": "), text)


def transcript(conversation: Column) -> Column:
    """The whole transcript of a parsed conversation, header line first."""
    lines = F.transform(
        conversation["messages"],
        lambda m: message_line(m["timestamp"], m["role"], m["is_public"], m["text"]),
    )
    header = F.concat(
        F.lit("Channel: "),
        F.coalesce(conversation["channel"], F.lit("unknown")),
        F.lit(" | Tags: "),
        F.array_join(F.coalesce(conversation["tags"], F.array().cast("array<string>")), ", "),
    )
    return F.concat(header, F.lit("\n\n"), F.array_join(lines, "\n"))


# Instructions and frames of the three judge requests.
_BINARY_SYSTEM = (
    "You are a senior QA evaluator determining the correct answer for a quality assessment.\n"
    "Read the conversation carefully, then evaluate against the given criteria.\n"
    'Answer ONLY "yes" or "no". Do not explain. Do not hedge. One word only.'
)
_BINARY_QUESTION = (
    "\n\nBased on the conversation above, does the agent's behavior satisfy the evaluation "
    'criteria? Answer "yes" or "no".'
)
_REJECT_SYSTEM = (
    "You are evaluating a customer support conversation against a quality criteria prompt.\n\n"
    'Answer "reject" ONLY if the prompt requires data that does not exist in the conversation '
    "transcript.\nExamples of data NOT in the transcript:\n"
    "- Customer's history from OTHER tickets or past interactions\n"
    "- External system data (CRM records, billing systems, purchase history)\n"
    "- Post-conversation outcomes (satisfaction scores, follow-up results)\n"
    "- Predictions about future customer behavior\n\n"
    "If the prompt can be answered using the conversation messages, timestamps, tags, channel, "
    'or speaker roles, answer "yes" or "no".\n\n'
    'Answer ONLY "yes", "no", or "reject". Nothing else.'
)
_REJECT_QUESTION = (
    "\n\nCan this evaluation criteria be assessed from the conversation above?\n"
    '- If yes: answer "yes" or "no" based on whether the criteria is met.\n'
    "- If the prompt requires information not present in the transcript: "
    'answer "reject".\n\nYour answer:'
)
REQUEST_FRAMES = {
    "truth": (_BINARY_SYSTEM, "CONVERSATION TRANSCRIPT:\n", "\n\nEVALUATION CRITERIA: ", _BINARY_QUESTION),
    "binary": (_BINARY_SYSTEM, "CONVERSATION TRANSCRIPT:\n", "\n\nEVALUATION PROMPT: ", _BINARY_QUESTION),
    "reject": (_REJECT_SYSTEM, "CONVERSATION:\n", "\n\nEVALUATION PROMPT: ", _REJECT_QUESTION),
}


def judge_request(kind: str, conversation_text: Column, prompt: Column) -> Column:
    """The system and user text of one judge request; nothing is sent from here."""
    system, opening, middle, question = REQUEST_FRAMES[kind]
    user = F.concat(F.lit(opening), conversation_text, F.lit(middle), prompt, F.lit(question))
    return F.struct(F.lit(system).alias("system"), user.alias("user"))


def template_family(subcategory: Column) -> Column:
    """The first family name, in this order, that the subcategory contains."""
    # Family names in matching order.
    families = [
        "explicit",
        "moderate",
        "implicit",
        "gt",
        "lt",
        "eq",
        "meta_tag",
        "meta_channel",
        "meta_notes",
    ]
    hits = F.array(*[F.when(subcategory.contains(f), F.lit(f)) for f in families])
    return F.coalesce(F.get(F.array_compact(hits), F.lit(0)), F.lit("other"))


def length_band(length: Column) -> Column:
    """Half-open length bands; 1000 and above belongs to none."""
    return (
        F.when(length < 100, "short").when(length < 500, "medium").when(length < 1000, "long")
    )


def category_rank(category: Column, order: list[str]) -> Column:
    """Position of a category in an explicit order; unknown ones sort last."""
    at = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(at > 0, at - 1).otherwise(F.lit(99)).cast("int")


def kappa_band(kappa: Column) -> Column:
    """Landis-Koch label; values between two printed bands are "Unknown"."""
    # Inclusive bands, best first.
    bands = [
        (0.81, 1.00, "Almost perfect"),
        (0.61, 0.80, "Substantial"),
        (0.41, 0.60, "Moderate"),
        (0.21, 0.40, "Fair"),
        (0.00, 0.20, "Slight"),
        (-1.0, 0.00, "Poor"),
    ]
    out = F
    for low, high, label in bands:
        out = out.when(kappa.between(F.lit(low), F.lit(high)), F.lit(label))
    return out.otherwise(F.lit("Unknown"))


def stars(p: Column) -> Column:
    """Conventional significance marks."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def acceptance_band(kappa: Column) -> Column:
    """Pass from 0.70, caution from 0.50, else fail."""
    return F.when(kappa >= 0.70, "PASS").when(kappa >= 0.50, "CAUTION").otherwise("FAIL")
