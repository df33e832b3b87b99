"""Queries over prompt and document texts: rules, extraction, audits, perturbation, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions import rules, text
from qaloom.operators import audits, curation, features, gates, metrics, prompts
from qaloom.plans import sql as Q
from qaloom.plans import tables as T
from qaloom.plans.registry import query
from qaloom.session import checkpoint

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("n1_templates", f"WITH {Q.PROMPTS} SELECT id, prompt, category, subcategory, style, noise, params FROM prompts")
def n1(spark, sf):
    return T.prompt_table(spark, sf).drop("conv_id")


def _perturb_sql() -> str:
    strength = "(CASE noise WHEN 'none' THEN 0.0 WHEN 'light' THEN 0.5 WHEN 'medium' THEN 1.0 ELSE 2.0 END)"

    def on(kind):
        return f"(noise <> 'none' AND {Q.unit(f'noise:{kind}', 'id')} <= {prompts.CHANCES[kind]}::DOUBLE * {strength}::DOUBLE)"

    def pick_at(options, seed):
        return Q.pick(options, seed, "id")

    slips = "CASE lower(c)"
    for c, options in prompts.KEY_SLIPS.items():
        slips += f" WHEN '{c}' THEN {Q.listed(options)}[CAST({Q.draw('noise:slip', 'id', '(i - 1)')} % 2 AS INTEGER) + 1]"
    slips += " ELSE c END"
    chars = f"list_transform(string_split(p, ''), lambda c, i: CASE WHEN {Q.unit('noise:char', 'id', '(i - 1)')} < 0.10 THEN {slips} ELSE c END)"
    steps = [f"CASE WHEN {on('keys')} THEN array_to_string({chars}, '') ELSE p END"]
    for w, options in prompts.WORD_SLIPS.items():
        value = pick_at(options, f"noise:misspelt:{w}")
        first = f"CASE WHEN instr(p, '{w}') > 0 THEN substr(p, 1, instr(p, '{w}') - 1) || {value} || substr(p, instr(p, '{w}') + {len(w)}) ELSE p END"
        steps.append(f"CASE WHEN {on('words')} AND contains(lower(p), '{w}') AND {Q.unit(f'noise:word:{w}', 'id')} < 0.20 THEN {first} ELSE p END")
    for w, options in prompts.INFORMAL.items():
        value = pick_at(options, f"noise:informal:{w}")
        steps.append(f"CASE WHEN {on('informal')} AND contains(lower(p), '{w}') AND {Q.unit(f'noise:formal:{w}', 'id')} < 0.25 THEN replace(p, '{w}', {value}) ELSE p END")
    for phrase, short in prompts.DROPPED.items():
        steps.append(f"CASE WHEN {on('articles')} AND {Q.unit(f'noise:article:{phrase}', 'id')} < 0.20 THEN regexp_replace(p, '^(.*?)\\b{phrase}\\b', '\\1{short}') ELSE p END")
    bare = "regexp_replace(p, '[?.!]+$', '')"
    mark = pick_at(["remove", "double", "dots"], "noise:mark")
    steps.append(f"CASE WHEN {on('marks')} THEN CASE {mark} WHEN 'remove' THEN {bare} WHEN 'double' THEN CASE WHEN p LIKE '%?' THEN p || '?' ELSE p END ELSE {bare} || '...' END ELSE p END")
    steps.append(f"CASE WHEN {on('case')} THEN CASE WHEN {Q.unit('noise:lower', 'id')} < 0.6 THEN lower(substr(p, 1, 1)) || substr(p, 2) ELSE lower(p) END ELSE p END")
    out = "s0 AS (SELECT id, noise, prompt AS p FROM prompts)"
    for i, step in enumerate(steps, 1):
        out += f",\ns{i} AS (SELECT id, noise, {step} AS p FROM s{i - 1})"
    return f"WITH {Q.PROMPTS},\n{out}\nSELECT id, noise, p AS prompt FROM s{len(steps)}"


@query("n2_perturb", _perturb_sql())
def n2(spark, sf):
    return T.noisy_prompts(spark, sf).select("id", "noise", "prompt")


_BARE = "regexp_replace(prompt, '[?.!]+$', '')"


def _first(word: str, other: str) -> str:
    return f"substr(prompt, 1, instr(prompt, '{word}') - 1) || '{other}' || substr(prompt, instr(prompt, '{word}') + {len(word)})"


@query(
    "n4_light_perturb",
    f"""WITH {Q.PROMPTS} SELECT id, CASE WHEN {Q.unit('light:any', 'id')} <= 0.30 THEN
      CASE {Q.pick(['lower_start', 'strip_mark', 'dots', 'casual'], 'light:kind', 'id')}
        WHEN 'lower_start' THEN lower(substr(prompt, 1, 1)) || substr(prompt, 2) WHEN 'strip_mark' THEN {_BARE}
        WHEN 'dots' THEN {_BARE} || '...'
        ELSE CASE WHEN contains(prompt, 'please ') THEN {_first('please ', '')} WHEN contains(prompt, 'Please ') THEN {_first('Please ', '')}
          WHEN contains(prompt, 'whether ') THEN {_first('whether ', 'if ')} WHEN contains(prompt, 'determine ') THEN {_first('determine ', 'check ')}
          ELSE prompt END END ELSE prompt END AS prompt FROM prompts""",
)
def n4(spark, sf):
    return prompts.perturb_lightly(T.prompt_table(spark, sf), "id", "prompt").select("id", "prompt")


@query("t1_polarity", f"WITH {Q.PROMPTS}, tagged AS ({Q.tagged('prompts')}) SELECT id, polarity, reason FROM tagged")
def t1(spark, sf):
    return curation.with_polarity(T.prompt_table(spark, sf)).select("id", "polarity", "reason")


def _hits(patterns: list[str]) -> str:
    each = ", ".join(f"regexp_extract(t, {Q.text(p)})" for p in patterns)
    return f"list_filter([{each}], lambda x: x <> '')"


@query(
    "t1_matched_keywords",
    f"""SELECT doc_id, reason, array_to_string(CASE reason WHEN 'blocked_external' THEN {_hits(rules.BLOCKED)} WHEN 'ambiguous' THEN list_concat({_hits(rules.UNDER)}, {_hits(rules.OVER)})
      WHEN 'under' THEN {_hits(rules.UNDER)} WHEN 'over' THEN {_hits(rules.OVER)} WHEN 'equal' THEN {_hits(rules.EQUAL)} ELSE [] END, '|') AS keywords
    FROM (SELECT doc_id, t, CASE WHEN {Q.side(rules.BLOCKED, 't')} THEN 'blocked_external' WHEN NOT regexp_matches(t, '\\b\\Q' || n || '\\E\\b') THEN 'threshold_not_in_text'
        WHEN {Q.side(rules.UNDER, 't')} AND {Q.side(rules.OVER, 't')} THEN 'ambiguous' WHEN {Q.side(rules.UNDER, 't')} THEN 'under'
        WHEN {Q.side(rules.OVER, 't')} THEN 'over' WHEN {Q.side(rules.EQUAL, 't')} THEN 'equal' ELSE 'no_keyword' END AS reason
      FROM (SELECT doc_id, lower(text || ' under ' || n_chars || ' over') AS t, n_chars::VARCHAR AS n FROM documents))""",
)
def t1_keywords(spark, sf):
    """Tags over whole document texts, with the document's own length as the stated threshold."""
    n = F.col("n_chars").cast("string")
    stated = F.concat("text", F.lit(" under "), n, F.lit(" over"))
    params = F.concat(F.lit('{"threshold": '), n, F.lit("}"))
    docs = T.documents(spark, sf).select("doc_id", stated.alias("p"), params.alias("q"))
    docs = docs.withColumn("tag", rules.polarity(F.col("p"), F.col("q")))
    words = rules.matched_keywords(F.col("p"), F.col("tag"))
    reason = F.coalesce("tag.polarity", "tag.reason")
    return docs.select("doc_id", reason.alias("reason"), F.array_join(words, "|").alias("keywords"))


@query(
    "t3_t4_operators",
    f"""WITH {Q.ADMITTED} SELECT id, json_extract_string(params, '$.operator') AS op,
      CASE WHEN json_extract_string(params, '$.operator') IN ('<', '<=') THEN 'under' ELSE 'over' END AS polarity
    FROM admitted WHERE category IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT')""",
)
def t3_t4(spark, sf):
    rows = T.admitted_prompts(spark, sf).where(F.col("category").isin("SYMBOLIC_TIME", "SYMBOLIC_COUNT"))
    op = F.get_json_object("params", "$.operator")
    return rows.select("id", op.alias("op"), rules.operator_polarity(op).alias("polarity"))


@query("t5_admission", f"WITH {Q.ADMITTED} SELECT id, category, polarity FROM tagged WHERE category IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT') AND polarity IN ('under', 'over')")
def t5(spark, sf):
    return curation.admitted(T.prompt_table(spark, sf), "category").select("id", "category", "polarity")


_UNIT = "CASE WHEN {u} IN ('sec', 'second') THEN 'seconds' WHEN {u} IN ('min', 'mins', 'minute') THEN 'minutes' WHEN {u} IN ('hr', 'hrs', 'hour') THEN 'hours' ELSE {u} END"
_EXTRACTED = f"""
extracted AS (
  SELECT *, CAST({Q.found('prompt', rules.TIME_NUMBER, 1)} AS DOUBLE) AS time_threshold,
    {_UNIT.format(u=f"lower({Q.found('prompt', rules.TIME_NUMBER, 2)})")} AS time_unit,
    CASE WHEN {Q.found('prompt', rules.TIME_NUMBER, 1)} IS NULL THEN NULL
      WHEN {Q.matches('prompt', rules.TIME_OVER)} AND NOT {Q.matches('prompt', rules.TIME_UNDER)} THEN '>' ELSE '<=' END AS time_operator,
    CAST(coalesce({", ".join(Q.found('prompt', p, 1) for p in rules.COUNT_FORMS)}) AS BIGINT) AS count_threshold,
    CASE WHEN {Q.matches('prompt', rules.META_NOTES)} THEN 'notes'
      WHEN {Q.found('prompt', rules.META_CHANNEL, 1)} IS NOT NULL AND {Q.matches('prompt', rules.META_CHANNEL_ROLE)} THEN 'channel'
      WHEN {Q.found('prompt', rules.META_TAG, 1)} IS NOT NULL THEN 'tag'
      WHEN {Q.found('prompt', rules.META_CHANNEL, 1)} IS NOT NULL THEN 'channel' END AS meta_subtype,
    lower({Q.found('prompt', rules.META_TAG, 1)}) AS tag_value, lower({Q.found('prompt', rules.META_CHANNEL, 1)}) AS channel_value
  FROM prompts),
extracted_value AS (SELECT *, CASE meta_subtype WHEN 'tag' THEN tag_value WHEN 'channel' THEN channel_value END AS meta_value FROM extracted)"""


@query("t6_time_params", f"WITH {Q.PROMPTS},{_EXTRACTED} SELECT id, time_threshold, time_unit, time_operator FROM extracted_value")
def t6(spark, sf):
    rows = T.prompt_table(spark, sf).select("id", rules.extract_time(F.col("prompt")).alias("t"))
    return rows.select(
        "id",
        F.col("t.threshold").alias("time_threshold"),
        F.col("t.unit").alias("time_unit"),
        F.col("t.operator").alias("time_operator"),
    )


@query("t7_count_params", f"WITH {Q.PROMPTS},{_EXTRACTED} SELECT id, count_threshold FROM extracted_value")
def t7(spark, sf):
    return T.prompt_table(spark, sf).select("id", rules.extract_count(F.col("prompt")).alias("count_threshold"))


@query("t8_metadata_params", f"WITH {Q.PROMPTS},{_EXTRACTED} SELECT id, meta_subtype, meta_value FROM extracted_value")
def t8(spark, sf):
    rows = T.prompt_table(spark, sf).select("id", rules.extract_metadata(F.col("prompt")).alias("m"))
    return rows.select("id", F.col("m.subtype").alias("meta_subtype"), F.col("m.value").alias("meta_value"))


_TRUE_UNIT = _UNIT.format(u="json_extract_string(params, '$.unit')")


@query(
    "t9_extraction_scores",
    f"""WITH {Q.PROMPTS},{_EXTRACTED},
    flags AS (SELECT category, subcategory,
      CASE category WHEN 'SYMBOLIC_TIME' THEN time_threshold IS NOT NULL WHEN 'SYMBOLIC_COUNT' THEN count_threshold IS NOT NULL ELSE meta_subtype IS NOT NULL END AS e,
      CASE category WHEN 'SYMBOLIC_TIME' THEN coalesce(time_threshold = json_extract_string(params, '$.threshold')::DOUBLE, false)
        WHEN 'SYMBOLIC_COUNT' THEN coalesce(count_threshold = json_extract_string(params, '$.threshold')::BIGINT, false) ELSE true END AS th,
      CASE category WHEN 'SYMBOLIC_TIME' THEN coalesce(time_unit = {_TRUE_UNIT}, false) ELSE true END AS un,
      CASE category WHEN 'SYMBOLIC_METADATA' THEN coalesce(meta_subtype = json_extract_string(params, '$.subtype'), false) ELSE true END AS su,
      CASE WHEN category = 'SYMBOLIC_METADATA' AND json_extract_string(params, '$.subtype') <> 'notes'
        THEN coalesce(meta_value, '') = coalesce(lower(json_extract_string(params, '$.value')), '') ELSE true END AS va
      FROM extracted_value WHERE starts_with(category, 'SYMBOLIC'))
    SELECT coalesce(category, 'ALL') AS category, coalesce(subcategory, 'ALL') AS subcategory, count(*) AS n, count(*) FILTER (WHERE e) AS extracted,
      count(*) FILTER (WHERE e AND th) AS match_threshold, count(*) FILTER (WHERE e AND un) AS match_unit, count(*) FILTER (WHERE e AND su) AS match_subtype,
      count(*) FILTER (WHERE e AND va) AS match_value, count(*) FILTER (WHERE e AND th AND un AND su AND va) AS correct
    FROM flags GROUP BY GROUPING SETS ((category), (subcategory), ())""",
)
def t9(spark, sf):
    return audits.extraction_scores(T.prompt_table(spark, sf), "prompt", "category", "subcategory", "params")


@query("t10_keyword_router", f"WITH {Q.PROMPTS} SELECT id, category, {Q.keyword_route()} AS routed FROM prompts")
def t10(spark, sf):
    return T.prompt_table(spark, sf).select("id", "category", rules.keyword_route(F.col("prompt")).alias("routed"))


@query("t11_extractable", f"WITH {Q.PROMPTS} SELECT id, {Q._IN_TEXT} AS extractable FROM prompts")
def t11(spark, sf):
    ok = rules.literally_extractable(F.col("prompt"), F.col("category"), F.col("params"))
    return T.prompt_table(spark, sf).select("id", ok.alias("extractable"))


_LEAK_WORDS = {"en": ["the", "and", "ing"], "fr": ["que", "the", "ou"], "de": ["und", "ein"], "es": ["que", "los"]}


@query(
    "t12_keyword_leakage",
    " UNION ALL ".join(
        f"SELECT lang, '{w}' AS word, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), '{w}')) AS n_hit, round(avg(CAST(contains(lower(text), '{w}') AS INTEGER)), 6) AS share FROM documents WHERE lang = '{c}' GROUP BY lang"
        for c, ws in _LEAK_WORDS.items() for w in ws
    ),
)
def t12(spark, sf):
    out = audits.keyword_leakage(T.documents(spark, sf), "lang", "text", _LEAK_WORDS)
    return out.withColumn("share", F.round("share", 6))


@query(
    "t13_surface_noise",
    """SELECT lang, count(*) AS n, round(avg(CAST(substr(text, 1, 1) <> upper(substr(text, 1, 1)) AND text <> '' AS INTEGER)), 6) AS lower_start,
    round(avg(CAST(regexp_extract(text, '(\\S)\\s*$', 1) NOT IN ('.', '?', '!', '') AND text <> '' AS INTEGER)), 6) AS no_final_mark,
    round(avg(CAST(contains(text, '??') OR contains(text, '...') AS INTEGER)), 6) AS doubled_marks,
    round(avg(CAST(regexp_matches(lower(text), 'plz|gonna|wanna|cuz| u ') AS INTEGER)), 6) AS informal FROM documents GROUP BY lang""",
)
def t13(spark, sf):
    out = audits.surface_noise(T.documents(spark, sf), "text", ["lang"])
    marks = ["lower_start", "no_final_mark", "doubled_marks", "informal"]
    return out.withColumns({m: F.round(m, 6) for m in marks})


@query(
    "t14_style_audit",
    f"""WITH {Q.PROMPTS} SELECT count(*) AS n, count(*) FILTER (WHERE contains(prompt, '?') <> (style = 'question')) AS n_mismatch,
    count(*) FILTER (WHERE contains(prompt, '?') AND style <> 'question') AS n_question_as_instruction,
    count(*) FILTER (WHERE NOT contains(prompt, '?') AND style = 'question') AS n_instruction_as_question FROM prompts""",
)
def t14(spark, sf):
    return audits.style_audit(T.prompt_table(spark, sf), "prompt", "style")


# ---- scalar text functions over documents ---------------------------------------------------


@query("b1_b2_b5_projection", f"WITH {Q.PROMPTS} SELECT id, prompt, category AS top_category FROM prompts WHERE starts_with(category, 'SYMBOLIC')")
def b1(spark, sf):
    rows = T.prompt_table(spark, sf).where(F.col("category").startswith("SYMBOLIC"))
    return rows.select("id", "prompt", text.collapse_category(F.col("category")).alias("top_category"))


@query("b3_b4_filters", f"WITH {Q.PROMPTS} SELECT id, category FROM prompts WHERE category IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT') AND params IS NOT NULL")
def b3(spark, sf):
    rows = T.prompt_table(spark, sf)
    return rows.where(F.col("category").isin("SYMBOLIC_TIME", "SYMBOLIC_COUNT") & F.col("params").isNotNull()).select("id", "category")


@query("b6_contains", "SELECT doc_id, contains(lower(text), 'the') AS has_the FROM documents")
def b6(spark, sf):
    return T.documents(spark, sf).select("doc_id", text.contains_ignoring_case(F.col("text"), "The").alias("has_the"))


@query(
    "b7_labels",
    "SELECT o_orderkey, CASE WHEN trim(o_orderstatus) NOT IN ('', 'NAN') THEN upper(trim(o_orderstatus)) END AS label FROM orders",
)
def b7(spark, sf):
    return T.table(spark, sf, "orders").select("o_orderkey", text.clean_label(F.lower(F.concat(F.lit(" "), "o_orderstatus"))).alias("label"))


@query("b8_mask_digits", "SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '<NUM>', 'g')) AS masked FROM documents")
def b8(spark, sf):
    return T.documents(spark, sf).select("doc_id", F.md5(text.mask_digits(F.col("text"))).alias("masked"))


@query(
    "b9_template",
    r"SELECT doc_id, md5(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[0-9]+', '<NUM>', 'g'), '\s+', ' ', 'g')) AS template FROM documents",
)
def b9(spark, sf):
    return T.documents(spark, sf).select("doc_id", F.md5(text.template_of(F.col("text"))).alias("template"))


@query(
    "b10_b18_style_length",
    "SELECT doc_id, CASE WHEN contains(text, '?') THEN 'question' ELSE 'instruction' END AS style, length(text) AS len, substr(text, 1, 60) AS head FROM documents",
)
def b10(spark, sf):
    t = F.col("text")
    return T.documents(spark, sf).select(
        "doc_id", text.style_of(t).alias("style"), F.length(t).cast("bigint").alias("len"), F.substring(t, 1, 60).alias("head")
    )


@query(
    "b14_parse_answer",
    r"""SELECT doc_id, CASE WHEN a IN ('yes', 'no', 'reject') THEN a WHEN contains(a, 'reject') AND NOT contains(a, 'yes') AND NOT contains(a, 'no') THEN 'reject'
      WHEN contains(a, 'yes') AND NOT contains(a, 'no') THEN 'yes' WHEN contains(a, 'no') AND NOT contains(a, 'yes') THEN 'no' ELSE 'invalid' END AS answer,
      CASE WHEN a IN ('yes', 'no', 'reject') THEN a ELSE 'invalid' END AS strict_answer
    FROM (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\.+$', '') AS a FROM documents)""",
)
def b14(spark, sf):
    t = F.col("text")
    return T.documents(spark, sf).select(
        "doc_id", text.parse_answer(t).alias("answer"), text.parse_answer(t, strict=True).alias("strict_answer")
    )


@query(
    "b19_template_family",
    f"""WITH {Q.PROMPTS} SELECT id, CASE WHEN contains(subcategory, 'explicit') THEN 'explicit' WHEN contains(subcategory, 'moderate') THEN 'moderate'
      WHEN contains(subcategory, 'implicit') THEN 'implicit' WHEN contains(subcategory, 'gt') THEN 'gt' WHEN contains(subcategory, 'lt') THEN 'lt'
      WHEN contains(subcategory, 'eq') THEN 'eq' WHEN contains(subcategory, 'meta_tag') THEN 'meta_tag' WHEN contains(subcategory, 'meta_channel') THEN 'meta_channel'
      WHEN contains(subcategory, 'meta_notes') THEN 'meta_notes' ELSE 'other' END AS family FROM prompts""",
)
def b19(spark, sf):
    return T.prompt_table(spark, sf).select("id", text.template_family(F.col("subcategory")).alias("family"))


# ---- audits ---------------------------------------------------------------------------------


@query(
    "g8_ttr",
    f"SELECT lang, count(DISTINCT w) AS n_types, count(*) AS n_tokens, round(count(DISTINCT w) / count(*)::DOUBLE, 6) AS ttr FROM (SELECT lang, unnest({_WORDS}) AS w FROM documents) GROUP BY lang",
)
def g8(spark, sf):
    out = audits.type_token_ratio(T.documents(spark, sf), "lang", "text")
    return out.withColumn("ttr", F.round("ttr", 6))


@query(
    "g9_length_stats",
    """SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean_len, max(length(text)) AS max_len, round(stddev_samp(length(text)), 6) AS std_len,
    count(*) FILTER (WHERE length(text) < 100) AS n_short, count(*) FILTER (WHERE length(text) BETWEEN 100 AND 499) AS n_medium,
    count(*) FILTER (WHERE length(text) BETWEEN 500 AND 999) AS n_long, round(quantile_cont(length(text), 0.5), 6) AS median_len FROM documents GROUP BY lang""",
)
def g9(spark, sf):
    out = audits.length_statistics(T.documents(spark, sf), "text", ["lang"])
    out = out.withColumns({c: F.round(c, 6) for c in ["mean_len", "std_len", "median_len"]})
    return out.withColumn("max_len", F.col("max_len").cast("bigint"))


@query(
    "g10_vocab_leakage",
    f"""WITH w AS (SELECT DISTINCT doc_id, lang, unnest({_WORDS}) AS word FROM documents),
    n AS (SELECT lang, count(*) AS n_docs, sum(count(*)) OVER () AS n_all FROM documents GROUP BY lang),
    d AS (SELECT lang, word, count(*) AS df, sum(count(*)) OVER (PARTITION BY word) AS df_all FROM w GROUP BY lang, word)
    SELECT word, lang, round(df / n_docs::DOUBLE, 6) AS freq_in, round((df_all - df) / (n_all - n_docs)::DOUBLE, 6) AS freq_out FROM d JOIN n USING (lang)
    WHERE df >= 0.25 * n_docs AND (df_all - df) / (n_all - n_docs)::DOUBLE < 0.05""",
)
def g10(spark, sf):
    out = audits.vocabulary_leaks(T.documents(spark, sf), "lang", "text")
    return out.withColumns({c: F.round(c, 6) for c in ["freq_in", "freq_out"]})


@query(
    "g6_imbalance",
    """SELECT source, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, round(n / min(n) OVER ()::DOUBLE, 6) AS ratio_to_smallest, round(max(n) OVER () / min(n) OVER ()::DOUBLE, 6) AS imbalance
    FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""",
)
def g6(spark, sf):
    out = metrics.class_balance(T.documents(spark, sf), "source")
    return out.withColumns({c: F.round(c, 6) for c in ["share", "ratio_to_smallest", "imbalance"]})


@query(
    "g7_crosstab",
    f"WITH {Q.PROMPTS} SELECT category, {', '.join(f'''count(*) FILTER (WHERE noise = '{v}') AS {v}''' for v in prompts.NOISE_SHARES)} FROM prompts GROUP BY category",
)
def g7(spark, sf):
    return metrics.crosstab(T.prompt_table(spark, sf), "category", "noise", list(prompts.NOISE_SHARES))


_TEMPLATE = r"regexp_replace(regexp_replace(lower(regexp_replace(prompt, '^\s+|\s+$', '', 'g')), '[0-9]+', '<NUM>', 'g'), '\s+', ' ', 'g')"


@query(
    "g27_template_overlap",
    f"""WITH {Q.PROMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {Q.draw('split', 'id')}, id) - 1 AS r, count(*) OVER (PARTITION BY category) AS n, {_TEMPLATE} AS template FROM prompts),
    s AS (SELECT category, template, CASE WHEN r < floor(n * 0.70::DOUBLE) THEN 'train' WHEN r < floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r),
    test AS (SELECT category, template, template IN (SELECT template FROM s WHERE split = 'train') AS seen FROM s WHERE split = 'test')
    SELECT category, count(*) AS n_test, count(*) FILTER (WHERE seen) AS n_overlap, round(100.0::DOUBLE * count(*) FILTER (WHERE seen) / count(*), 6) AS overlap_percent FROM test GROUP BY category
    UNION ALL SELECT 'ALL', count(DISTINCT template), count(DISTINCT template) FILTER (WHERE seen), round(100.0::DOUBLE * count(DISTINCT template) FILTER (WHERE seen) / count(DISTINCT template), 6) FROM test""",
)
def g27(spark, sf):
    rows = curation.stratified_split(checkpoint(T.prompt_table(spark, sf)), "category", "id")
    out = audits.template_overlap(
        rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test"), "category", "prompt"
    )
    return out.withColumn("overlap_percent", F.round("overlap_percent", 6))


# ---- text features --------------------------------------------------------------------------

_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_]+')"
_TF = f"""{Q.SPLIT},
words AS (SELECT doc_id, lang, split, {_TERMS} AS w FROM split_docs),
unigrams AS (SELECT doc_id, split, unnest(w) AS term FROM words),
bigrams AS (SELECT doc_id, split, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS term FROM words WHERE len(w) > 1),
tf AS (SELECT doc_id, split, term, count(*) AS tf FROM (SELECT * FROM unigrams UNION ALL SELECT * FROM bigrams) GROUP BY ALL)"""


def _tfidf_sql(source: str, limit: int) -> str:
    return f"""WITH {_TF.replace('(SELECT * FROM unigrams UNION ALL SELECT * FROM bigrams)', source)},
    vocabulary AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term ORDER BY total DESC, term LIMIT {limit}),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM split_docs WHERE split = 'train')) / (1 + df)::DOUBLE) + 1 AS idf FROM vocabulary),
    raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN idf USING (term) WHERE split = 'test')
    SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""


def _tfidf(spark, sf, largest, limit):
    docs = T.split_documents(spark, sf)
    train, test = docs.where(F.col("split") == "train"), docs.where(F.col("split") == "test")
    out = features.tfidf(train, test, "doc_id", "text", limit, largest)
    return out.withColumn("weight", F.round("weight", 6))


@query("m1_tfidf", _tfidf_sql("(SELECT * FROM unigrams UNION ALL SELECT * FROM bigrams)", 10_000))
def m1(spark, sf):
    return _tfidf(spark, sf, 2, 10_000)


@query("m2_tfidf_unigrams", _tfidf_sql("unigrams", 5_000))
def m2(spark, sf):
    return _tfidf(spark, sf, 1, 5_000)


@query(
    "m6_naive_bayes",
    f"""WITH {_TF.replace('(SELECT * FROM unigrams UNION ALL SELECT * FROM bigrams)', 'unigrams')},
    vocabulary AS (SELECT term FROM tf WHERE split = 'train' GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000),
    counts AS (SELECT lang, term, sum(tf) AS n FROM tf JOIN (SELECT doc_id, lang FROM split_docs) USING (doc_id) JOIN vocabulary USING (term) WHERE split = 'train' GROUP BY ALL),
    classes AS (SELECT lang, count(*) AS n_docs, ln(count(*) / (SELECT count(*) FROM split_docs WHERE split = 'train')::DOUBLE) AS prior FROM split_docs WHERE split = 'train' GROUP BY lang),
    mass AS (SELECT lang, prior, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = k.lang), 0) + (SELECT count(*) FROM vocabulary) AS mass FROM classes k),
    scores AS (SELECT d.doc_id, m.lang, any_value(prior) + coalesce(sum(t.tf * ln((coalesce(c.n, 0) + 1) / mass::DOUBLE)), 0) AS score
      FROM (SELECT doc_id FROM split_docs WHERE split = 'test') d CROSS JOIN mass m
      LEFT JOIN (SELECT * FROM tf JOIN vocabulary USING (term)) t ON t.doc_id = d.doc_id LEFT JOIN counts c ON c.term = t.term AND c.lang = m.lang GROUP BY ALL)
    SELECT doc_id, arg_max(lang, score) AS prediction, round(max(score), 4) AS score FROM scores GROUP BY doc_id""",
)
def m6(spark, sf):
    docs = T.split_documents(spark, sf)
    train, test = docs.where(F.col("split") == "train"), docs.where(F.col("split") == "test")
    out = features.naive_bayes(train, test, "doc_id", "text", "lang")
    return out.withColumn("score", F.round("score", 4))


@query(
    "m11_baselines",
    f"""WITH {Q.SPLIT}, k AS (SELECT lang, count(*) AS n FROM split_docs WHERE split = 'train' GROUP BY lang),
    steps AS (SELECT lang, sum(n) OVER (ORDER BY lang) / sum(n) OVER ()::DOUBLE AS upto FROM k),
    t AS (SELECT doc_id, {Q.unit('prior', 'doc_id')} AS u FROM split_docs WHERE split = 'test')
    SELECT doc_id, (SELECT lang FROM k ORDER BY n DESC, lang LIMIT 1) AS majority, min(lang) AS by_prior FROM t JOIN steps ON upto > u GROUP BY doc_id""",
)
def m11(spark, sf):
    docs = T.split_documents(spark, sf)
    train, test = docs.where(F.col("split") == "train"), docs.where(F.col("split") == "test")
    return features.prior_baselines(train, test, "doc_id", "lang").select("doc_id", "majority", "by_prior")


@query(
    "v1_v3_gates",
    f"""WITH {Q.ADMITTED}, e AS (SELECT category, count(*) AS n FROM prompts GROUP BY category)
    SELECT 'V1_category_count' AS rule, count(*) AS n_violations FROM e WHERE category <> 'HYBRID' OR n <> 10 HAVING count(*) > 0
    UNION ALL SELECT 'V2_missing_truth', count(*) FROM prompts WHERE params IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'V3_missing_operator', count(*) FROM prompts WHERE category IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT') HAVING count(*) > 0""",
)
def v1_v3(spark, sf):
    """Gates over the raw prompts, which have no operators yet; the admitted ones must all pass V3."""
    raw, usable = T.prompt_table(spark, sf), T.admitted_prompts(spark, sf)
    return gates.rule_counts(
        gates.category_counts(raw, "category", {"HYBRID": 10}),
        gates.unique_and_complete(raw, "id", "params"),
        gates.operators_agree(raw, "id", "category", "prompt", "params"),
        gates.operators_agree(usable, "id", "category", "prompt", "params"),
    )
