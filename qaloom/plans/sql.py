"""SQL fragments of the oracles: the derived tables written a second time, independently, in SQL."""

from __future__ import annotations

from qaloom.functions import rules
from qaloom.operators import prompts as P
from qaloom.schemas import CLASSES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in values) + "]"


def draw(seed: str, *keys: str) -> str:
    parts = ", ".join([text(seed), *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 13) AS BIGINT)"


def unit(seed: str, *keys: str) -> str:
    return f"({draw(seed, *keys)} / 4503599627370496::DOUBLE)"


def pick(options, seed: str, *keys: str) -> str:
    return f"({listed(options)})[CAST({draw(seed, *keys)} % {len(options)} AS INTEGER) + 1]"


def weighted(shares: dict[str, float], seed: str, *keys: str) -> str:
    out, total, names = "CASE", 0.0, list(shares)
    for name in names[:-1]:
        total += shares[name]
        out += f" WHEN {unit(seed, *keys)} < {round(total, 9)} THEN {text(name)}"
    return f"{out} ELSE {text(names[-1])} END"


def matches(subject: str, pattern: str) -> str:
    return f"regexp_matches({subject}, {text(pattern)})"


def found(subject: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({subject}, {text(pattern)}, {group}), '')"


def _prompts() -> str:
    level = "CASE"
    for category, levels in P.LEVELS.items():
        level += f" WHEN category = {text(category)} THEN {pick(levels, 'prompt:level', 'id')}"
    level += f" ELSE {weighted(P.SUBTYPE_SHARES, 'prompt:subtype', 'id')} END"
    template = "CASE"
    for (category, name, style), options in P.TEMPLATES.items():
        template += (
            f" WHEN category = {text(category)} AND level = {text(name)} AND style = {text(style)}"
            f" THEN {pick(options, 'prompt:template', 'id')}"
        )
    template += " END"
    return f"""
prompt_base AS (
  SELECT o_orderkey AS id, o_custkey AS conv_id,
    {weighted(P.CATEGORY_SHARES, 'prompt:category', 'o_orderkey')} AS category,
    {weighted(P.STYLE_SHARES, 'prompt:style', 'o_orderkey')} AS style,
    {weighted(P.NOISE_SHARES, 'prompt:noise', 'o_orderkey')} AS noise,
    {pick(P.NUMBERS, 'prompt:number', 'o_orderkey')} AS n,
    {pick(P.UNITS, 'prompt:unit', 'o_orderkey')} AS u
  FROM orders),
prompt_level AS (SELECT *, {level} AS level FROM prompt_base),
prompt_value AS (
  SELECT *, CASE WHEN level = 'channel' THEN {pick(P.CHANNELS, 'prompt:channel', 'id')}
    ELSE {pick(P.TAGS, 'prompt:tag', 'id')} END AS v FROM prompt_level),
prompts AS (
  SELECT id, conv_id, category, style, noise,
    replace(replace(replace({template}, '{{n}}', CAST(n AS VARCHAR)), '{{u}}', u), '{{v}}', v) AS prompt,
    CASE category WHEN 'SYMBOLIC_TIME' THEN 'time_' WHEN 'SYMBOLIC_COUNT' THEN 'count_'
      WHEN 'SYMBOLIC_METADATA' THEN 'meta_' ELSE '' END || level AS subcategory,
    CASE WHEN category = 'SYMBOLIC_TIME' THEN '{{"threshold": ' || n || ', "unit": "' || u || '"}}'
      WHEN category = 'SYMBOLIC_COUNT' THEN '{{"threshold": ' || n || '}}'
      WHEN category = 'SYMBOLIC_METADATA' AND level = 'notes' THEN '{{"subtype": "notes", "value": null}}'
      WHEN category = 'SYMBOLIC_METADATA' THEN '{{"subtype": "' || level || '", "value": "' || v || '"}}'
    END AS params
  FROM prompt_value)"""


def side(patterns: list[str], subject: str = "lower(prompt)") -> str:
    return matches(subject, "|".join(f"(?:{p})" for p in patterns))


def tagged(source: str) -> str:
    """T1 over a table with prompt and params."""
    threshold = "json_extract_string(params, '$.threshold')"
    word = f"coalesce(regexp_matches(lower(prompt), '\\b\\Q' || {threshold} || '\\E\\b'), false)"
    return f"""
  SELECT *, CASE WHEN reason = 'ok' THEN CASE WHEN is_under THEN 'under' WHEN is_over THEN 'over' ELSE 'equal' END END AS polarity
  FROM (SELECT *, CASE WHEN {side(rules.BLOCKED)} THEN 'blocked_external'
      WHEN NOT {word} THEN 'threshold_not_in_text' WHEN is_under AND is_over THEN 'ambiguous'
      WHEN is_under OR is_over OR is_equal THEN 'ok' ELSE 'no_keyword' END AS reason
    FROM (SELECT *, {side(rules.UNDER)} AS is_under, {side(rules.OVER)} AS is_over,
        {side(rules.EQUAL)} AS is_equal FROM {source}))"""


PROMPTS = _prompts()

ADMITTED = f"""{PROMPTS},
tagged AS ({tagged('prompts')}),
admitted AS (
  SELECT id, conv_id, prompt, category, subcategory, style, noise,
    CASE WHEN category IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT') THEN
      substr(params, 1, length(params) - 1) || ', "operator": "' ||
      CASE WHEN polarity = 'over' THEN '>' WHEN category = 'SYMBOLIC_TIME' THEN '<=' ELSE '<' END || '"}}'
    ELSE params END AS params
  FROM tagged
  WHERE category NOT IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT') OR polarity IN ('under', 'over'))"""

MESSAGES = """
messages AS (
  SELECT user_id AS conv_id, event_id AS seq, ts,
    CASE WHEN event_type IN ('view', 'purchase') THEN 'customer' ELSE 'agent' END AS role,
    event_type <> 'error' AS is_public,
    CASE WHEN value > 150 THEN event_type END AS tag
  FROM events)"""

FIRST = f"""{MESSAGES},
asked AS (
  SELECT conv_id, ts AS asked_at FROM messages WHERE role = 'customer' AND is_public
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY seq) = 1),
answered AS (
  SELECT m.conv_id, m.ts AS answered_at FROM messages m JOIN asked a USING (conv_id)
  WHERE m.role = 'agent' AND m.is_public AND m.ts > a.asked_at
  QUALIFY row_number() OVER (PARTITION BY m.conv_id ORDER BY m.seq) = 1),
first_response AS (
  SELECT conv_id, asked_at, answered_at,
    (epoch_us(answered_at) - epoch_us(asked_at)) / 6e7::DOUBLE AS response_minutes
  FROM asked LEFT JOIN answered USING (conv_id))"""

FEATURES = f"""{FIRST},
features AS (
  SELECT m.conv_id, count(*) FILTER (WHERE is_public) AS n_public, count(*) AS n_messages,
    bool_or(NOT is_public) AS has_notes,
    coalesce(list_sort(list(DISTINCT tag) FILTER (WHERE tag IS NOT NULL)), []) AS tags,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7::DOUBLE, 1) AS resolution_minutes,
    any_value(f.response_minutes) AS response_minutes,
    {pick(P.CHANNELS, 'channel', 'm.conv_id')} AS channel
  FROM messages m LEFT JOIN first_response f USING (conv_id) GROUP BY m.conv_id)"""


def answer_of(category: str, days: bool = True) -> str:
    """C10/C11 over admitted params joined with features."""
    threshold = "CAST(json_extract_string(params, '$.threshold') AS DOUBLE)"
    unit_text = "coalesce(json_extract_string(params, '$.unit'), 'minutes')"
    seconds = "('seconds', 'sec', 'secs')" if days else "('seconds', 'sec')"
    hours = "('hours', 'hrs', 'hr')" if days else "('hours', 'hrs')"
    limit = (
        f"CASE WHEN {unit_text} IN {seconds} THEN {threshold} / 60.0::DOUBLE "
        f"WHEN {unit_text} IN {hours} THEN {threshold} * 60.0::DOUBLE ELSE {threshold} END"
    )
    op = "json_extract_string(params, '$.operator')"

    def compare(left: str, right: str) -> str:
        return (
            f"CASE WHEN coalesce(CASE {op} WHEN '<' THEN {left} < {right} WHEN '<=' THEN {left} <= {right} "
            f"WHEN '>' THEN {left} > {right} END, false) THEN 'yes' ELSE 'no' END"
        )

    value = "coalesce(json_extract_string(params, '$.value'), '')"
    subtype = "json_extract_string(params, '$.subtype')"

    def flag(test: str) -> str:
        return f"CASE WHEN {test} THEN 'yes' ELSE 'no' END"

    return f"""CASE {category}
    WHEN 'SYMBOLIC_TIME' THEN {compare('response_minutes', f'({limit})')}
    WHEN 'SYMBOLIC_COUNT' THEN {compare('n_public', f'CAST({threshold} AS BIGINT)')}
    WHEN 'SYMBOLIC_METADATA' THEN CASE {subtype}
      WHEN 'tag' THEN {flag(f'list_contains(tags, lower({value}))')}
      WHEN 'channel' THEN {flag(f'lower(channel) = lower({value})')}
      WHEN 'notes' THEN {flag('has_notes')} END END"""


def keyword_route(prompt: str = "prompt") -> str:
    t, c, m = (matches(prompt, p) for p in (rules.ROUTE_TIME, rules.ROUTE_COUNT, rules.ROUTE_METADATA))
    u, s = matches(prompt, rules.ROUTE_UNSUPPORTED), matches(f"lower({prompt})", "|".join(rules.SEMANTIC_WORDS))
    return f"""CASE WHEN {u} AND NOT ({t} OR {c} OR {m}) THEN 'UNSUPPORTED'
    WHEN ({t} OR {c} OR {m}) AND {s} THEN 'HYBRID' WHEN {t} THEN 'SYMBOLIC_TIME'
    WHEN {c} THEN 'SYMBOLIC_COUNT' WHEN {m} THEN 'SYMBOLIC_METADATA' ELSE 'SEMANTIC' END"""


PAIRS = f"""{ADMITTED},{FEATURES},
pair_truth AS (
  SELECT *, CASE WHEN starts_with(category, 'SYMBOLIC') THEN {answer_of('category')}
      WHEN category = 'UNSUPPORTED' THEN 'reject'
      WHEN {unit('judged', 'id')} < 0.6 THEN 'yes' ELSE 'no' END AS truth
  FROM (SELECT a.*, response_minutes, resolution_minutes, coalesce(channel, '') AS channel, coalesce(n_public, 0) AS n_public,
      coalesce(n_messages, 0) AS n_messages, coalesce(has_notes, false) AS has_notes, coalesce(tags, []) AS tags
    FROM admitted a LEFT JOIN features f USING (conv_id))),
pairs AS (
  SELECT *,
    CASE WHEN {unit('router', 'id')} < 0.9 THEN category ELSE {pick(CLASSES, 'misroute', 'id')} END AS pred_learned,
    round(0.2::DOUBLE + 0.5::DOUBLE * {unit('confidence', 'id')} + CASE WHEN {unit('router', 'id')} < 0.9 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 4) AS conf_learned,
    {keyword_route()} AS pred_keyword, 1.0::DOUBLE AS conf_keyword,
    CASE WHEN {unit('judge', 'id')} < 0.7 THEN truth
      ELSE {pick(['yes', 'no', 'invalid', 'no'], 'reply', 'id')} END AS judge_answer,
    200 + {draw('tokens', 'id')} % 300 AS judge_tokens,
    round(100.0::DOUBLE + 900.0::DOUBLE * {unit('latency', 'id')}, 2) AS judge_latency_ms,
    CASE WHEN starts_with(category, 'SYMBOLIC') THEN 'deterministic'
      WHEN category = 'UNSUPPORTED' THEN 'rejection' ELSE 'judge' END AS truth_source
  FROM pair_truth)"""

_THRESHOLD = "json_extract_string(params, '$.threshold')"


def routed(predicted: str) -> str:
    computed = answer_of(predicted, days=False)
    no_params = f"(params IS NULL OR ({_THRESHOLD} IS NULL AND {predicted} IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT')))"
    meta_other = f"({predicted} = 'SYMBOLIC_METADATA' AND json_extract_string(params, '$.subtype') IS NULL)"
    return f"""CASE WHEN starts_with({predicted}, 'SYMBOLIC') THEN CASE WHEN {no_params} THEN 'invalid'
      WHEN {meta_other} THEN CASE WHEN list_contains(tags, '') THEN 'yes' ELSE 'no' END
      ELSE {computed} END
    WHEN {predicted} = 'UNSUPPORTED' THEN 'reject' ELSE judge_answer END"""


_FALLBACK = "(CASE WHEN conf_learned < 0.5 THEN 'SEMANTIC' ELSE pred_learned END)"
_IN_TEXT = """CASE WHEN NOT starts_with(category, 'SYMBOLIC') THEN false
    WHEN category = 'SYMBOLIC_METADATA' THEN contains(lower(prompt),
      CASE WHEN json_extract_string(params, '$.subtype') = 'notes' THEN 'none' ELSE lower(json_extract_string(params, '$.value')) END)
    ELSE contains(prompt, json_extract_string(params, '$.threshold')) END"""

ROUTED = f"""{PAIRS},
routed_answers AS (
  SELECT *, judge_answer AS j_answer, {routed(_FALLBACK)} AS routed_answer, {routed('pred_keyword')} AS keyword_answer,
    CASE WHEN starts_with(pred_learned, 'SYMBOLIC') THEN CASE WHEN pred_learned = category THEN truth ELSE 'invalid' END
      WHEN pred_learned = 'UNSUPPORTED' THEN 'reject' ELSE judge_answer END AS strict_answer,
    CASE WHEN starts_with(pred_learned, 'SYMBOLIC') AND pred_learned = category AND {_IN_TEXT} THEN truth
      WHEN pred_learned = 'UNSUPPORTED' THEN 'reject' ELSE judge_answer END AS deployed_answer
  FROM pairs),
routed_pairs AS (
  SELECT *, CAST(j_answer = truth AS INTEGER) AS judge_correct,
    CAST(routed_answer = truth AS INTEGER) AS routed_correct,
    CAST(keyword_answer = truth AS INTEGER) AS keyword_correct,
    CAST(strict_answer = truth AS INTEGER) AS strict_correct,
    CAST(deployed_answer = truth AS INTEGER) AS deployed_correct
  FROM routed_answers)"""

LABELLED = f"""
labelled AS (
  SELECT *, CAST("length" = quality AS INTEGER) AS length_correct, CAST(words = quality AS INTEGER) AS words_correct,
    CAST(random = quality AS INTEGER) AS random_correct, CAST(constant = quality AS INTEGER) AS constant_correct
  FROM (SELECT d.doc_id, lang, source, n_chars, quality, toxic, CAST(n_chars > 1000 AS INTEGER) AS "length",
      CAST(contains(lower(text), ' the ') AS INTEGER) AS words,
      CAST({unit('guess', 'd.doc_id')} < 0.8 AS INTEGER) AS random, 1 AS constant
    FROM documents d JOIN labels USING (doc_id)))"""

SYSTEM_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, lang, n_chars, '{s}' AS system, {s}_correct AS correct FROM labelled"
    for s in ["length", "words", "random", "constant"]
)

PROBABILITIES = f"""
raw_p AS (
  SELECT doc_id, lang, [{", ".join(f"{unit(f'p:{x}', 'doc_id')} + CASE WHEN lang = '{x}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for x in ['de', 'en', 'es', 'fr'])}] AS raw
  FROM documents),
probabilities AS (
  SELECT doc_id, lang, p, list_max(p) AS confidence,
    (['de', 'en', 'es', 'fr'])[list_position(p, list_max(p))] AS prediction
  FROM (SELECT doc_id, lang, list_transform(raw, lambda x: x / (raw[1] + raw[2] + raw[3] + raw[4])) AS p FROM raw_p))"""

RUNS = f"""
runs AS (
  SELECT *, CAST(answer = ground_truth AS INTEGER) AS correct FROM (
    SELECT event_type AS model, CAST({draw('run', 'event_id')} % 5 AS INTEGER) AS run, user_id AS idx,
      {pick(['SYMBOLIC_TIME', 'SYMBOLIC_COUNT', 'SYMBOLIC_METADATA'], 'cat', 'user_id')} AS category,
      CASE WHEN value < 15 THEN 'no' WHEN value < 150 THEN 'yes' ELSE 'invalid' END AS answer,
      CASE WHEN {unit('truth', 'user_id')} < 0.8 THEN 'yes' ELSE 'no' END AS ground_truth,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
      20 + {draw('length', 'user_id')} % 100 AS prompt_len, value AS latency_ms
    FROM events))"""

SPLIT = f"""
ranked_docs AS (
  SELECT doc_id, text, lang, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY {draw('split', 'doc_id')}, doc_id) - 1 AS r FROM documents),
split_docs AS (
  SELECT doc_id, text, lang, CASE WHEN r < floor(n * 0.70::DOUBLE) THEN 'train'
    WHEN r < floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM ranked_docs)"""
