"""Queries that score systems: metrics, repeated runs, statistics, calibration, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from qaloom.functions import draws, rules
from qaloom.operators import (
    agreement,
    bootstrap,
    calibration,
    metrics,
    repeats,
    routing,
    significance,
)
from qaloom.plans import sql as Q
from qaloom.plans import tables as T
from qaloom.plans.registry import query
from qaloom.session import checkpoint

_POLICIES = ["judge", "routed", "keyword", "strict", "deployed"]
_REPLICATES = 5000
_F1_REPLICATES = 1000


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- accuracy, latency, tables --------------------------------------------------------------

_FREE_SQL = {
    "judge": "false",
    "routed": "conf_learned >= 0.5 AND (starts_with(pred_learned, 'SYMBOLIC') OR pred_learned = 'UNSUPPORTED')",
    "keyword": "starts_with(pred_keyword, 'SYMBOLIC') OR pred_keyword = 'UNSUPPORTED'",
    "strict": "starts_with(pred_learned, 'SYMBOLIC') OR pred_learned = 'UNSUPPORTED'",
    "deployed": f"pred_learned = 'UNSUPPORTED' OR (starts_with(pred_learned, 'SYMBOLIC') AND pred_learned = category AND {Q._IN_TEXT})",
}
_POLICY_ROWS = " UNION ALL ".join(
    f"""SELECT '{p}' AS system, category, truth_source, {p}_correct AS correct, CASE WHEN {free} THEN 0 ELSE judge_tokens END AS tokens,
    CASE WHEN {free} THEN 0.0::DOUBLE ELSE judge_latency_ms END AS latency_ms FROM routed_pairs"""
    for p, free in _FREE_SQL.items()
)


def policy_results(spark, sf):
    """One row per (pair, policy) with correctness and, where the judge was asked, its cost."""
    learned, category = F.col("pred_learned"), F.col("category")
    fallback = routing.with_fallback(learned, F.col("conf_learned"), 0.5)
    text_gives = rules.literally_extractable(F.col("prompt"), category, F.col("params"))
    computed_deployed = learned.isin(*routing.SYMBOLIC) & (learned == category) & text_gives
    free = {
        "judge": F.lit(False),
        "routed": routing.unjudged(fallback),
        "keyword": routing.unjudged(F.col("pred_keyword")),
        "strict": routing.unjudged(learned),
        "deployed": (learned == "UNSUPPORTED") | computed_deployed,
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("system"),
                F.col(f"{p}_correct").alias("correct"),
                F.when(f, F.lit(0)).otherwise(F.col("judge_tokens")).alias("tokens"),
                F.when(f, F.lit(0.0)).otherwise(F.col("judge_latency_ms")).alias("latency_ms"),
            )
            for p, f in free.items()
        ]
    )
    return T.routed_pairs(spark, sf).select("id", "category", "truth_source", F.inline(rows))


@query(
    "g1_system_summary",
    f"""WITH {Q.ROUTED}, long AS ({_POLICY_ROWS}) SELECT system, count(*) AS n, round(avg(correct), 6) AS accuracy, sum(tokens)::BIGINT AS total_tokens,
    round(avg(latency_ms), 6) AS mean_latency_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms FROM long GROUP BY system""",
)
def g1(spark, sf):
    results = checkpoint(policy_results(spark, sf))  # the fact table; summaries read it again
    out = metrics.system_summary(results)
    return _rounded(out, ["accuracy", "mean_latency_ms", "p50_latency_ms", "p95_latency_ms"])


@query(
    "g2_latency_profile",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
)
def g2(spark, sf):
    out = metrics.latency_profile(T.table(spark, sf, "events"), ["event_type"], "value")
    return _rounded(out, ["mean", "p50", "p95", "p99"])


@query(
    "g3_by_category",
    f"WITH {Q.LABELLED} SELECT lang, count(*) AS n, {', '.join(f'round(avg({s}_correct), 6) AS {s}' for s in T.SYSTEMS)} FROM labelled GROUP BY lang",
)
def g3(spark, sf):
    return _rounded(metrics.accuracy_table(T.labelled_documents(spark, sf), "lang", T.SYSTEMS), T.SYSTEMS)


@query(
    "g4_by_source",
    f"WITH {Q.ROUTED} SELECT coalesce(truth_source, 'ALL') AS truth_source, count(*) AS n, {', '.join(f'round(avg({s}_correct), 6) AS {s}' for s in _POLICIES)} FROM routed_pairs GROUP BY GROUPING SETS ((truth_source), ())",
)
def g4(spark, sf):
    return _rounded(metrics.accuracy_by_source(T.routed_pairs(spark, sf), "truth_source", _POLICIES), _POLICIES)


@query(
    "g5_answerable",
    f"WITH {Q.ROUTED}, long AS ({_POLICY_ROWS}) SELECT system, count(*) AS n, count(*) FILTER (WHERE category <> 'UNSUPPORTED') AS n_answerable, round(avg(correct), 6) AS accuracy, round(avg(correct) FILTER (WHERE category <> 'UNSUPPORTED'), 6) AS answerable_accuracy FROM long GROUP BY system",
)
def g5(spark, sf):
    out = metrics.answerable_accuracy(T.routed_pairs(spark, sf), "category", _POLICIES)
    return _rounded(out, ["accuracy", "answerable_accuracy"])


@query(
    "g13_g24_accuracy_by",
    f"WITH {Q.LABELLED}, long AS ({Q.SYSTEM_ROWS}) SELECT system, lang, count(*) AS n, round(avg(correct), 6) AS accuracy FROM long GROUP BY system, lang",
)
def g13(spark, sf):
    long = metrics.to_long(T.labelled_documents(spark, sf), ["lang"], T.SYSTEMS)
    return _rounded(metrics.accuracy_by(long, ["system", "lang"]), ["accuracy"])


@query(
    "g17_confusion",
    f"WITH {Q.PAIRS} SELECT category, pred_keyword, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY category)::DOUBLE, 6) AS row_share FROM pairs GROUP BY category, pred_keyword",
)
def g17(spark, sf):
    return _rounded(metrics.confusion(T.pairs(spark, sf), "category", "pred_keyword"), ["row_share"])


@query(
    "g18_confusion_pairs",
    f"""WITH {Q.PAIRS}, w AS (SELECT category, pred_keyword, prompt, row_number() OVER (PARTITION BY category, pred_keyword ORDER BY id) AS r FROM pairs WHERE category <> pred_keyword)
    SELECT category, pred_keyword, count(*) AS n, string_agg(prompt, ' / ' ORDER BY r) FILTER (WHERE r <= 3) AS examples FROM w GROUP BY category, pred_keyword""",
)
def g18(spark, sf):
    out = metrics.confusion_pairs(T.pairs(spark, sf), "category", "pred_keyword", "id", "prompt")
    return out.withColumn("examples", F.array_join("examples", " / "))


_F1 = """c AS (SELECT DISTINCT x FROM (SELECT t AS x FROM tp UNION ALL SELECT p FROM tp)),
k AS (SELECT x, (SELECT count(*) FROM tp WHERE t = x) AS support, (SELECT count(*) FROM tp WHERE p = x) AS predicted, (SELECT count(*) FROM tp WHERE t = x AND p = x) AS hit FROM c),
f AS (SELECT x AS class, support, predicted, hit, CASE WHEN predicted > 0 THEN hit / predicted::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS recall,
  CASE WHEN predicted + support > 0 THEN 2 * hit / (predicted + support)::DOUBLE ELSE 0 END AS f1 FROM k)"""


@query(
    "g19_f1",
    f"WITH {Q.PAIRS}, tp AS (SELECT category AS t, pred_keyword AS p FROM pairs), {_F1} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f",
)
def g19(spark, sf):
    out = metrics.class_scores(T.pairs(spark, sf), "category", "pred_keyword")
    out = _rounded(out, ["precision", "recall", "f1"]).withColumn("support", F.col("support").cast("bigint"))
    return out.drop("tp")


@query(
    "g19_overall",
    f"""WITH {Q.PAIRS}, tp AS (SELECT category AS t, pred_keyword AS p FROM pairs), {_F1} SELECT sum(support)::BIGINT AS n, round(sum(hit) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
    round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(support * f1) / sum(support)::DOUBLE, 6) AS weighted_f1 FROM f""",
)
def g19_overall(spark, sf):
    out = metrics.overall_scores(metrics.class_scores(T.pairs(spark, sf), "category", "pred_keyword"))
    return _rounded(out, ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"])


@query(
    "g20_label_overlap",
    """WITH r AS (SELECT CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS a, CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END AS b FROM labels), l AS (SELECT unnest(['yes', 'no']) AS label)
    SELECT label, count(*) FILTER (WHERE a = label AND b = label) AS both, count(*) FILTER (WHERE a = label) AS n_a, count(*) FILTER (WHERE b = label) AS n_b,
    count(*) FILTER (WHERE a = label OR b = label) AS either, round(count(*) FILTER (WHERE a = label AND b = label) / count(*) FILTER (WHERE a = label OR b = label)::DOUBLE, 6) AS jaccard FROM r, l GROUP BY label""",
)
def g20(spark, sf):
    return _rounded(agreement.label_overlap(_raters(spark, sf), "a", "b"), ["jaccard"])


def _raters(spark, sf):
    def said(c):
        return F.when(F.col(c) == 1, "yes").otherwise("no")

    rows = T.table(spark, sf, "labels").join(T.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select(
        "doc_id", "lang", said("quality").alias("a"), said("toxic").alias("b"),
        F.when(F.col("n_chars") > 1000, "yes").otherwise("no").alias("ref"),
    )


_RATERS = """raters AS (SELECT doc_id, lang, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS a, CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END AS b,
  CASE WHEN n_chars > 1000 THEN 'yes' ELSE 'no' END AS ref FROM labels JOIN documents USING (doc_id))"""


@query(
    "g21_rater_accuracy",
    f"WITH {_RATERS} " + " UNION ALL ".join(f"SELECT ref, '{r}' AS rater, count(*) AS n, count(*) FILTER (WHERE {r} = ref) AS n_right, round(avg(CAST({r} = ref AS INTEGER)), 6) AS accuracy FROM raters GROUP BY ref" for r in "ab"),
)
def g21(spark, sf):
    return _rounded(agreement.rater_accuracy(_raters(spark, sf), "ref", ["a", "b"]), ["accuracy"])


@query(
    "g22_disagreement",
    f"WITH {_RATERS} " + " UNION ALL ".join(f"SELECT ref, '{r}' AS rater, count(*) AS n, count(*) FILTER (WHERE {r} <> ref) AS n_differ, round(avg(CAST({r} <> ref AS INTEGER)), 6) AS rate FROM raters GROUP BY ref" for r in "ab"),
)
def g22(spark, sf):
    return _rounded(agreement.disagreement_by(_raters(spark, sf), "ref", ["a", "b"]), ["rate"])


@query(
    "g23_generalisation_gap",
    f"""WITH {Q.LABELLED}, long AS ({Q.SYSTEM_ROWS}), s AS (SELECT system, {Q.unit('holdout', 'doc_id')} < 0.5 AS held, correct FROM long)
    SELECT system, round(avg(correct) FILTER (WHERE NOT held), 6) AS test, round(avg(correct) FILTER (WHERE held), 6) AS holdout, round(avg(correct) FILTER (WHERE NOT held) - avg(correct) FILTER (WHERE held), 6) AS gap FROM s GROUP BY system""",
)
def g23(spark, sf):
    long = metrics.to_long(T.labelled_documents(spark, sf), ["doc_id"], T.SYSTEMS)
    held = draws.unit("holdout", F.col("doc_id")) < 0.5
    test = metrics.accuracy_by(long.where(~held), ["system"])
    rest = metrics.accuracy_by(long.where(held), ["system"])
    return _rounded(metrics.generalisation_gap(test, rest, "system", "accuracy"), ["test", "holdout", "gap"])


_BEST = f"{Q.LABELLED}, long AS ({Q.SYSTEM_ROWS}), acc AS (SELECT lang, system, avg(correct) AS accuracy FROM long GROUP BY lang, system)"


@query(
    "g25_best_system",
    f"WITH {_BEST} SELECT lang, min(system) AS system, round(max(accuracy), 6) AS accuracy FROM acc a WHERE accuracy = (SELECT max(accuracy) FROM acc b WHERE b.lang = a.lang) GROUP BY lang",
)
def g25(spark, sf):
    long = metrics.to_long(T.labelled_documents(spark, sf), ["lang"], T.SYSTEMS)
    scores = metrics.accuracy_by(long, ["lang", "system"]).drop("n")
    return _rounded(metrics.best_per(scores, ["lang"], "system", "accuracy"), ["accuracy"])


@query(
    "p16_top_models",
    f"WITH {_BEST} SELECT system, round(accuracy, 6) AS accuracy FROM (SELECT system, avg(correct) AS accuracy FROM long GROUP BY system) ORDER BY accuracy DESC, system LIMIT 2",
)
def p16(spark, sf):
    long = metrics.to_long(T.labelled_documents(spark, sf), [], T.SYSTEMS)
    scores = metrics.accuracy_by(long, ["system"]).drop("n")
    return _rounded(metrics.top_models(scores, "system", "accuracy"), ["accuracy"])


@query(
    "g29_error_listing",
    f"WITH {Q.ROUTED} SELECT id, 'wrong_answer' AS error_type, category, pred_learned FROM routed_pairs WHERE routed_correct = 0 UNION ALL SELECT id, 'misroute', category, pred_learned FROM routed_pairs WHERE category <> pred_learned",
)
def g29(spark, sf):
    rows = T.routed_pairs(spark, sf).withColumn("ok", F.col("routed_correct") == 1)
    return metrics.error_listing(rows, "id", "ok", "category", "pred_learned")


# ---- repeated runs --------------------------------------------------------------------------

_ITEMS = f"{Q.RUNS}, items AS (SELECT model, idx, count(DISTINCT answer) AS unique_answers, sum(correct)::BIGINT AS correct_runs, count(*) AS total_runs FROM runs GROUP BY model, idx)"


@query("g11_reliability_items", f"WITH {_ITEMS} SELECT * FROM items")
def g11_items(spark, sf):
    return repeats.answer_counts(T.repeat_runs(spark, sf), ["model", "idx"], "answer", "correct")


@query(
    "g11_reliability",
    f"WITH {_ITEMS} SELECT model, count(*) AS n_items, count(*) FILTER (WHERE unique_answers > 1) AS n_inconsistent, round(avg(CAST(unique_answers > 1 AS INTEGER)), 6) AS inconsistent_share, round(sum(correct_runs) / sum(total_runs)::DOUBLE, 6) AS accuracy FROM items GROUP BY model",
)
def g11(spark, sf):
    items = repeats.answer_counts(T.repeat_runs(spark, sf), ["model", "idx"], "answer", "correct")
    return _rounded(repeats.inconsistency(items, ["model"]), ["inconsistent_share", "accuracy"])


@query(
    "g12_run_stats",
    f"""WITH {_ITEMS}, r AS (SELECT model, run, avg(correct) AS a FROM runs GROUP BY model, run)
    SELECT model, n_runs, round(mean_accuracy, 6) AS mean_accuracy, round(std_accuracy, 6) AS std_accuracy, n_items, n_inconsistent, round(mean_tokens, 6) AS mean_tokens, round(mean_latency, 6) AS mean_latency, round(p50, 6) AS p50, round(p95, 6) AS p95
    FROM (SELECT model, count(*) AS n_runs, avg(a) AS mean_accuracy, stddev_samp(a) AS std_accuracy FROM r GROUP BY model)
    JOIN (SELECT model, count(*) AS n_items, count(*) FILTER (WHERE unique_answers > 1) AS n_inconsistent FROM items GROUP BY model) USING (model)
    JOIN (SELECT model, avg(tokens) AS mean_tokens, avg(latency_ms) AS mean_latency, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95 FROM runs GROUP BY model) USING (model)""",
)
def g12(spark, sf):
    out = repeats.run_statistics(
        T.repeat_runs(spark, sf), "model", "run", "idx", "answer", "correct", "tokens", "latency_ms"
    )
    return _rounded(out, ["mean_accuracy", "std_accuracy", "mean_tokens", "mean_latency", "p50", "p95"])


_WIDE = f"""{Q.RUNS}, wide AS (SELECT idx, category, {", ".join(f"avg(correct) FILTER (WHERE model = '{m}') AS {m}" for m in T.MODELS)} FROM runs GROUP BY idx, category)"""


def _items(spark, sf):
    return repeats.item_accuracy(T.repeat_runs(spark, sf), ["idx", "category"], "model", T.MODELS, "correct")


@query(
    "g14_win_lose",
    f"""WITH {_WIDE} SELECT idx, category, {", ".join(f"round({m}, 6) AS {m}" for m in T.MODELS)}, coalesce(click >= 0.8 AND view <= 0.2, false) AS first_wins, coalesce(view >= 0.8 AND click <= 0.2, false) AS second_wins,
    coalesce({" AND ".join(f"{m} <= 0.2" for m in T.MODELS)}, false) AS all_wrong, coalesce({" AND ".join(f"{m} >= 0.8" for m in T.MODELS)}, false) AS all_right FROM wide""",
)
def g14(spark, sf):
    return _rounded(repeats.win_lose(_items(spark, sf), "click", "view", T.MODELS), T.MODELS)


@query(
    "g15_error_overlap",
    f"WITH {_WIDE} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS model_a, '{b}' AS model_b, count(*) FILTER (WHERE {a} < 0.5 AND {b} < 0.5) AS shared, count(*) FILTER (WHERE {a} < 0.5 OR {b} < 0.5) AS total, round(count(*) FILTER (WHERE {a} < 0.5 AND {b} < 0.5) / nullif(count(*) FILTER (WHERE {a} < 0.5 OR {b} < 0.5), 0)::DOUBLE, 6) AS jaccard FROM wide"
        for i, a in enumerate(T.MODELS) for b in T.MODELS[i + 1 :]
    ),
)
def g15(spark, sf):
    wrong = repeats.majority_wrong(_items(spark, sf), T.MODELS)
    return _rounded(repeats.error_overlap(wrong, T.MODELS), ["jaccard"])


@query(
    "g15_error_sets",
    f"WITH {_WIDE} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS model, count(*) FILTER (WHERE {m} < 0.5) AS n_wrong, count(*) FILTER (WHERE {m} >= 0.5 AND {' AND '.join(f'{o} < 0.5' for o in T.MODELS if o != m)}) AS n_uniquely_solved, count(*) FILTER (WHERE {' AND '.join(f'{o} < 0.5' for o in T.MODELS)}) AS universal FROM wide"
        for m in T.MODELS
    ),
)
def g15_sets(spark, sf):
    return repeats.error_sets(repeats.majority_wrong(_items(spark, sf), T.MODELS), T.MODELS)


@query(
    "g16_inconsistent_by_category",
    f"WITH {Q.RUNS}, i AS (SELECT model, idx, category, count(DISTINCT answer) AS k FROM runs WHERE answer IN ('yes', 'no') GROUP BY ALL) SELECT model, category, count(*) AS n_inconsistent FROM i WHERE k > 1 GROUP BY model, category",
)
def g16(spark, sf):
    return repeats.inconsistent_by_category(T.repeat_runs(spark, sf), "model", "idx", "category", "answer", ["yes", "no"])


@query(
    "b24_cost",
    """SELECT model, round(i, 6) AS mean_in, round(o, 6) AS mean_out, round(i / 1e6 * pi + o / 1e6 * po, 9) AS cost_each, round((i / 1e6 * pi + o / 1e6 * po) * 30000, 6) AS cost_daily
    FROM (SELECT l_returnflag AS model, avg(l_quantity) AS i, avg(l_linenumber) AS o, CASE l_returnflag WHEN 'A' THEN 1.10::DOUBLE ELSE 15.0::DOUBLE END AS pi, CASE l_returnflag WHEN 'A' THEN 4.40::DOUBLE ELSE 60.0::DOUBLE END AS po
      FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag)""",
)
def b24(spark, sf):
    prices = {"A": repeats.PRICES["o3-mini"], "R": repeats.PRICES["o1"]}
    out = repeats.cost(
        T.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "model"), "model", "l_quantity", "l_linenumber", prices
    )
    return _rounded(_rounded(out, ["mean_in", "mean_out", "cost_daily"]), ["cost_each"], 9)


@query(
    "r7_tool_sweep",
    f"""WITH {Q.RUNS} SELECT model, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(tokens), 6) AS tokens_per_prompt, round(avg(prompt_len % 4), 6) AS calls_per_prompt, count(*) FILTER (WHERE answer IS NULL) AS n_errors,
    count(*) FILTER (WHERE answer NOT IN ('yes', 'no', 'reject')) AS n_invalid, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
    round(avg(correct) FILTER (WHERE category = 'SYMBOLIC_TIME'), 6) AS time_accuracy FROM runs GROUP BY model""",
)
def r7(spark, sf):
    out = metrics.tool_sweep(
        T.repeat_runs(spark, sf), "model", "category", F.col("prompt_len") % 4, ["yes", "no", "reject"]
    )
    out = out.withColumn("time_accuracy", F.col("accuracy_by")["SYMBOLIC_TIME"]).drop("accuracy_by")
    return _rounded(out, ["accuracy", "tokens_per_prompt", "calls_per_prompt", "p50", "p95", "time_accuracy"])


# ---- significance ---------------------------------------------------------------------------

_BASE, _ROUTERS = ["judge"], ["routed", "keyword", "strict", "deployed"]


def _angle(p: str) -> str:
    return f"2 * asin(sqrt(greatest(0.001::DOUBLE, least(0.999::DOUBLE, {p}))))"


_BC = " UNION ALL ".join(
    f"SELECT '{x}' AS baseline, '{y}' AS router, count(*) FILTER (WHERE {x}_correct = 0 AND {y}_correct = 1) AS b, count(*) FILTER (WHERE {x}_correct = 1 AND {y}_correct = 0) AS c, avg({x}_correct) AS p1, avg({y}_correct) AS p2 FROM routed_pairs"
    for x in _BASE for y in _ROUTERS
)
# erf by the midpoint rule: an independent way to the same tail probability.
_TAIL = "CASE WHEN chi2 > 80 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(4000), lambda i: exp(-pow((i + 0.5) * sqrt(chi2 / 2) / 4000, 2)))) * sqrt(chi2 / 2) / 4000) END"
_MCNEMAR = f"""{Q.ROUTED}, bc AS ({_BC}),
chi AS (SELECT *, CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c) END::DOUBLE AS chi2 FROM bc),
pv AS (SELECT *, round({_TAIL}, 6) AS p_value FROM chi),
ranked AS (SELECT *, row_number() OVER (ORDER BY p_value, baseline, router) AS r, count(*) OVER () AS k FROM pv),
holm AS (SELECT *, max(least(1.0, p_value * (k - r + 1))) OVER (ORDER BY r) AS p_holm FROM ranked)"""


@query(
    "s1_s2_mcnemar",
    f"WITH {_MCNEMAR} SELECT baseline, router, b, c, round(chi2, 4) AS chi2, round({_angle('p2')} - {_angle('p1')}, 6) AS cohens_h, round(p_value, 5) AS p_value, p_value < 0.05 AS significant FROM holm",
)
def s1(spark, sf):
    out = significance.mcnemar_table(T.routed_pairs(spark, sf), _BASE, _ROUTERS)
    out = out.select("baseline", "router", "b", "c", "chi2", "cohens_h", "p_value", "significant")
    return _rounded(_rounded(_rounded(out, ["chi2"], 4), ["cohens_h"]), ["p_value"], 5)


@query(
    "s4_holm",
    f"WITH {_MCNEMAR} SELECT baseline, router, round(p_holm, 5) AS p_holm, p_holm < 0.05 AS significant_holm, CASE WHEN p_holm < 0.001 THEN '***' WHEN p_holm < 0.01 THEN '**' WHEN p_holm < 0.05 THEN '*' ELSE 'ns' END AS stars FROM holm",
)
def s4(spark, sf):
    out = significance.mcnemar_table(T.routed_pairs(spark, sf), _BASE, _ROUTERS)
    return _rounded(out.select("baseline", "router", "p_holm", "significant_holm", "stars"), ["p_holm"], 5)


@query(
    "s3_cohens_h",
    f"WITH {Q.LABELLED} SELECT lang, round({_angle('avg(length_correct)')} - {_angle('avg(constant_correct)')}, 6) AS cohens_h FROM labelled GROUP BY lang",
)
def s3(spark, sf):
    means = T.labelled_documents(spark, sf).groupBy("lang").agg(
        F.avg("constant_correct").alias("p1"), F.avg("length_correct").alias("p2")
    )
    return means.select("lang", F.round(significance.cohens_h(F.col("p1"), F.col("p2")), 6).alias("cohens_h"))


_TWO = """SELECT model, n1, n0, mean1, mean0, n1 + n0 - 2 AS dof, (mean1 - mean0) / sqrt(pooled * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) AS t, (mean1 - mean0) / sqrt(pooled) AS d
FROM (SELECT model, count(*) FILTER (WHERE correct = 1) AS n1, count(*) FILTER (WHERE correct = 0) AS n0, avg({v}) FILTER (WHERE correct = 1) AS mean1, avg({v}) FILTER (WHERE correct = 0) AS mean0,
  ((count(*) FILTER (WHERE correct = 1) - 1) * var_samp({v}) FILTER (WHERE correct = 1) + (count(*) FILTER (WHERE correct = 0) - 1) * var_samp({v}) FILTER (WHERE correct = 0)) / (count(*) - 2) AS pooled FROM {s} GROUP BY model)"""


@query(
    "s13_s15_ttest",
    f"WITH {Q.RUNS} SELECT model, n1, n0, round(mean1, 6) AS mean1, round(mean0, 6) AS mean0, dof, round(t, 6) AS t, round(d, 6) AS cohens_d FROM ({_TWO.format(v='tokens', s='runs')})",
)
def s13(spark, sf):
    out = significance.two_sample(T.repeat_runs(spark, sf), "correct", "tokens", ["model"])
    return _rounded(out, ["mean1", "mean0", "t", "cohens_d"])


# Two-sided tail of Student's t by the midpoint rule in the angle atan(t / sqrt(dof)).
_T_TAIL = "1 - list_sum(list_transform(range(20000), lambda i: pow(cos((i + 0.5) / 20000 * atan(abs(t) / sqrt(dof))), dof - 1))) * atan(abs(t) / sqrt(dof)) / list_sum(list_transform(range(20000), lambda i: pow(cos((i + 0.5) / 20000 * pi() / 2), dof - 1))) / (pi() / 2)"


@query(
    "s13_t_p_value",
    f"WITH {Q.RUNS} SELECT model, round({_T_TAIL}, 4) AS p_value FROM ({_TWO.format(v='tokens', s='runs')})",
)
def s13_p(spark, sf):
    out = significance.two_sample(T.repeat_runs(spark, sf), "correct", "tokens", ["model"])
    return _rounded(significance.with_t_p_value(out).select("model", "p_value"), ["p_value"], 4)


@query(
    "s14_length_adjusted",
    f"""WITH {Q.RUNS}, fit AS (SELECT model, regr_slope(tokens, prompt_len) AS a, regr_intercept(tokens, prompt_len) AS b FROM runs GROUP BY model),
    rest AS (SELECT model, correct, tokens - (a * prompt_len + b) AS v FROM runs JOIN fit USING (model))
    SELECT model, n1, n0, round(t, 6) AS t, round(d, 6) AS cohens_d FROM ({_TWO.format(v='v', s='rest')})""",
)
def s14(spark, sf):
    out = significance.length_adjusted(T.repeat_runs(spark, sf), "correct", "tokens", "prompt_len", ["model"])
    return _rounded(out.select("model", "n1", "n0", "t", "cohens_d"), ["t", "cohens_d"])


@query(
    "s12_t_interval",
    f"""WITH {Q.RUNS}, r AS (SELECT model, run, avg(correct) AS a FROM runs GROUP BY model, run)
    SELECT model, n_runs, round(mean, 6) AS mean, round(std, 6) AS std, 'interval' AS kind, round(mean - 2.7764451051977934 * std / sqrt(n_runs), 6) AS low, round(mean + 2.7764451051977934 * std / sqrt(n_runs), 6) AS high
    FROM (SELECT model, count(*) AS n_runs, avg(a) AS mean, stddev_samp(a) AS std FROM r GROUP BY model)""",
)
def s12(spark, sf):
    out = significance.t_interval(T.repeat_runs(spark, sf), ["model"], "run", "correct")
    return _rounded(out, ["mean", "std", "low", "high"])


@query(
    "s16_chi2",
    """WITH o AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source), r AS (SELECT lang, count(*) AS rn FROM documents GROUP BY lang), c AS (SELECT source, count(*) AS cn FROM documents GROUP BY source), t AS (SELECT count(*) AS total FROM documents)
    SELECT total, (SELECT count(*) FROM r) * (SELECT count(*) FROM c) - (SELECT count(*) FROM r) - (SELECT count(*) FROM c) + 1 AS dof, round(sum(pow(coalesce(n, 0) - rn * cn / total::DOUBLE, 2) / (rn * cn / total::DOUBLE)), 6) AS chi2
    FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o ON o.lang = r.lang AND o.source = c.source GROUP BY total""",
)
def s16(spark, sf):
    out = significance.chi2_independence(T.table(spark, sf, "documents"), "lang", "source")
    return out.select("total", F.col("dof").cast("bigint").alias("dof"), F.round("chi2", 6).alias("chi2"))


@query("s16_chi2_p_value")
def s16_p(spark, sf):
    out = significance.chi2_independence(T.table(spark, sf, "documents"), "lang", "source")
    return out.select("dof", F.round("p_value", 6).alias("p_value"))


# ---- agreement ------------------------------------------------------------------------------

_KAPPA = """SELECT {by} count(*)::DOUBLE AS n, avg(CAST(a = b AS INTEGER)) AS agreement,
  (count(*) FILTER (WHERE a = 'yes') * count(*) FILTER (WHERE b = 'yes') + count(*) FILTER (WHERE a = 'no') * count(*) FILTER (WHERE b = 'no')) / pow(count(*), 2) AS expected FROM raters {group}"""
_BANDS = """CASE WHEN kappa BETWEEN 0.81 AND 1 THEN 'Almost perfect' WHEN kappa BETWEEN 0.61 AND 0.80 THEN 'Substantial' WHEN kappa BETWEEN 0.41 AND 0.60 THEN 'Moderate'
  WHEN kappa BETWEEN 0.21 AND 0.40 THEN 'Fair' WHEN kappa BETWEEN 0.00 AND 0.20 THEN 'Slight' WHEN kappa BETWEEN -1 AND 0 THEN 'Poor' ELSE 'Unknown' END AS band,
  CASE WHEN kappa >= 0.7 THEN 'PASS' WHEN kappa >= 0.5 THEN 'CAUTION' ELSE 'FAIL' END AS acceptance"""


@query(
    "s8_s10_kappa",
    f"""WITH {_RATERS}, k AS (SELECT *, (agreement - expected) / (1 - expected) AS kappa FROM ({_KAPPA.format(by='lang,', group='GROUP BY lang')}))
    SELECT lang, n::BIGINT AS n, round(agreement, 6) AS agreement, round(expected, 6) AS expected, round(kappa, 6) AS kappa, round(2 * agreement - 1, 6) AS pabak, {_BANDS} FROM k WHERE n >= 5""",
)
def s8(spark, sf):
    out = agreement.kappa(_raters(spark, sf), "a", "b", ["lang"], min_n=5)
    out = _rounded(out, ["agreement", "expected", "kappa", "pabak"])
    return out.withColumn("n", F.col("n").cast("bigint"))


@query(
    "s11_prevalence",
    f"WITH {_RATERS}, l AS (SELECT 'a' AS rater, a AS label FROM raters UNION ALL SELECT 'b', b FROM raters) SELECT rater, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY rater)::DOUBLE, 6) AS share FROM l GROUP BY rater, label",
)
def s11(spark, sf):
    return _rounded(agreement.prevalence(_raters(spark, sf), ["a", "b"]), ["share"])


# ---- bootstrap ------------------------------------------------------------------------------


# Draws differ between engines, so a query states facts about its interval: the estimate, and whether the bounds lie
# where theory puts them (for a mean: near the normal bounds, a bootstrap quantile being a whole count over n).


def _near_normal(df):
    """Whether the bounds of an interval of means are near the estimate plus and minus 1.96 standard errors."""
    error = F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n"))
    slack = 0.3 * error + 1.5 / F.col("n")
    low = F.abs(F.col("ci_lo") - (F.col("accuracy") - 1.96 * error)) <= slack
    high = F.abs(F.col("ci_hi") - (F.col("accuracy") + 1.96 * error)) <= slack
    return df.withColumns({"low_near": low, "high_near": high, "replicates": F.lit(_REPLICATES)}).drop("ci_lo", "ci_hi")


def _around(df, value):
    """Whether the interval holds its estimate and is about as wide as the delta method says, ``error`` being its standard error."""
    inside = (F.col("ci_lo") <= F.col(value)) & (F.col(value) <= F.col("ci_hi"))
    width, normal, step = F.col("ci_hi") - F.col("ci_lo"), 2 * 1.96 * F.col("error"), 4 / F.col("rows")
    near = (width >= 0.5 * normal - step) & (width <= 1.5 * normal + step)
    return df.withColumn("inside", inside & near).drop("ci_lo", "ci_hi", "error", "rows")


def _class_f1_errors(scores):
    """Standard error of each class's F1 by the delta method, with the sum of its support and predictions as ``rows``."""
    predicted = F.when(F.col("tp") > 0, F.col("tp") / F.col("precision")).otherwise(0)
    scores = scores.withColumn("rows", F.col("support") + predicted)
    missed = F.col("rows") - 2 * F.col("tp")
    spread = 4 * F.col("tp") * (1 - F.col("f1")) ** 2 + F.col("f1") ** 2 * missed
    return scores.withColumn("error", F.sqrt(spread) / F.col("rows"))


def _macro_f1_errors(rows, scores):
    """Standard error of macro-F1 by the delta method, from confusion cells."""
    cells = rows.groupBy("system", "lang", "p").agg(F.count("*").alias("n"))
    facts = _class_f1_errors(scores).select("system", "class", F.col("f1").alias("f"), F.col("rows").alias("d"))
    facts = facts.withColumn("k", F.count("*").over(Window.partitionBy("system")))
    truth = facts.select("system", F.col("class").alias("lang"), "f", "d", "k")
    guess = facts.select("system", F.col("class").alias("p"), F.col("f").alias("fp"), F.col("d").alias("dp"))
    wrong = -F.col("f") / F.col("d") - F.when(F.col("dp") > 0, F.col("fp") / F.col("dp")).otherwise(0)
    slope = F.when(F.col("lang") == F.col("p"), 2 * (1 - F.col("f")) / F.col("d")).otherwise(wrong) / F.col("k")
    met = cells.join(truth, ["system", "lang"]).join(guess, ["system", "p"])
    return met.groupBy("system").agg(F.sqrt(F.sum(F.col("n") * slope**2)).alias("error"), F.sum("n").alias("rows"))


def _kappa_errors(rows):
    """Standard error of kappa by the delta method, per language."""
    cells = rows.groupBy("lang", "a", "b").agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang")
    cells = cells.withColumn("total", F.sum("n").over(group))
    a = cells.groupBy("lang", F.col("a").alias("label")).agg((F.sum("n") / F.first("total")).alias("pa"))
    b = cells.groupBy("lang", F.col("b").alias("label")).agg((F.sum("n") / F.first("total")).alias("pb"))
    shares = a.join(b, ["lang", "label"], "full").na.fill(0.0, ["pa", "pb"])
    expected = shares.groupBy("lang").agg(F.sum(F.col("pa") * F.col("pb")).alias("pe"))
    met = cells.join(shares.select("lang", F.col("label").alias("a"), "pb"), ["lang", "a"])
    met = met.join(shares.select("lang", F.col("label").alias("b"), "pa"), ["lang", "b"]).join(expected, "lang")
    same = (F.col("a") == F.col("b")).cast("double")
    met = met.withColumn("po", F.sum(F.col("n") * same).over(group) / F.col("total"))
    slope = (same - F.col("po")) / (1 - F.col("pe")) - (1 - F.col("po")) / (1 - F.col("pe")) ** 2 * (F.col("pa") + F.col("pb") - 2 * F.col("pe"))
    return met.groupBy("lang").agg((F.sqrt(F.sum(F.col("n") * slope**2)) / F.first("total")).alias("error"), F.first("total").alias("rows"))


@query(
    "s5_bootstrap_mean",
    f"""WITH {Q.LABELLED}, long AS ({Q.SYSTEM_ROWS})
    SELECT system, count(*) AS n, round(avg(correct), 6) AS accuracy, true AS low_near, true AS high_near, {_REPLICATES} AS replicates FROM long GROUP BY system""",
)
def s5(spark, sf):
    long = metrics.to_long(T.labelled_documents(spark, sf), [], T.SYSTEMS)
    return _rounded(_near_normal(bootstrap.mean_interval(long, ["system"], "correct", _REPLICATES)), ["accuracy"])


@query(
    "s6_bootstrap_by_category",
    f"""WITH {Q.LABELLED}, long AS ({Q.SYSTEM_ROWS})
    SELECT system, lang, count(*) AS n, round(avg(correct), 6) AS accuracy, true AS low_near, true AS high_near, {_REPLICATES} AS replicates FROM long GROUP BY system, lang HAVING count(*) > 1""",
)
def s6(spark, sf):
    long = metrics.to_long(T.labelled_documents(spark, sf), ["lang"], T.SYSTEMS)
    out = bootstrap.mean_interval(long, ["system", "lang"], "correct", _REPLICATES, min_n=2)
    return _rounded(_near_normal(out), ["accuracy"])


_F1 = """long AS (SELECT system, lang AS t, p FROM (SELECT 'argmax' AS system, lang, prediction AS p FROM probabilities UNION ALL SELECT 'english', lang, 'en' FROM probabilities)),
sides AS (SELECT system, t AS class, 1 AS support, 0 AS predicted, CASE WHEN t = p THEN 1 ELSE 0 END AS hit FROM long UNION ALL SELECT system, p, 0, 1, 0 FROM long),
f AS (SELECT system, class, sum(support) AS support, 2 * sum(hit) / sum(support + predicted)::DOUBLE AS f1 FROM sides GROUP BY ALL)"""


def _language_guesses(spark, sf):
    p = T.document_probabilities(spark, sf)
    rows = F.array(
        F.struct(F.lit("argmax").alias("system"), F.col("prediction").alias("p")),
        F.struct(F.lit("english").alias("system"), F.lit("en").alias("p")),
    )
    return p.select("lang", F.inline(rows))


@query(
    "s7_bootstrap_f1",
    f"WITH {Q.PROBABILITIES}, {_F1} SELECT system, round(avg(f1), 6) AS macro_f1, true AS inside FROM f GROUP BY system",
)
def s7(spark, sf):
    rows = _language_guesses(spark, sf)
    errors = _macro_f1_errors(rows, metrics.class_scores(rows, "lang", "p", ["system"]))
    out = bootstrap.macro_f1_interval(rows, ["system"], "lang", "p", _F1_REPLICATES).join(errors, "system")
    return _rounded(_around(out, "macro_f1"), ["macro_f1"])


@query(
    "s7_bootstrap_class_f1",
    f"WITH {Q.PROBABILITIES}, {_F1} SELECT system, class, round(f1, 6) AS f1, support, true AS inside FROM f WHERE support > 0",
)
def s7_class(spark, sf):
    rows = _language_guesses(spark, sf)
    errors = _class_f1_errors(metrics.class_scores(rows, "lang", "p", ["system"])).select("system", "class", "error", "rows")
    out = bootstrap.class_f1_interval(rows, ["system"], "lang", "p", _F1_REPLICATES).join(errors, ["system", "class"])
    return _rounded(_around(out, "f1").withColumn("support", F.col("support").cast("bigint")), ["f1"])


@query(
    "s9_bootstrap_kappa",
    f"""WITH {_RATERS}, k AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (WHERE a = b) AS same, count(*) FILTER (WHERE a = 'yes') * count(*) FILTER (WHERE b = 'yes') + count(*) FILTER (WHERE a = 'no') * count(*) FILTER (WHERE b = 'no') AS cross_n FROM raters GROUP BY lang)
    SELECT lang, round((same / n - cross_n / (n * n)) / (1 - cross_n / (n * n)), 6) AS kappa, true AS inside FROM k""",
)
def s9(spark, sf):
    rows = _raters(spark, sf)
    out = bootstrap.kappa_interval(rows, "a", "b", ["lang"], _REPLICATES).join(_kappa_errors(rows), "lang")
    return _rounded(_around(out, "kappa").select("lang", "kappa", "inside"), ["kappa"])


# The intervals themselves: no SQL, as draws differ between engines; tests hold the bounds against resampled rows.


@query("s5_mean_interval")
def s5_interval(spark, sf):
    long = metrics.to_long(T.labelled_documents(spark, sf), [], T.SYSTEMS)
    return bootstrap.mean_interval(long, ["system"], "correct", _REPLICATES)


@query("s6_category_interval")
def s6_interval(spark, sf):
    long = metrics.to_long(T.labelled_documents(spark, sf), ["lang"], T.SYSTEMS)
    return bootstrap.mean_interval(long, ["system", "lang"], "correct", _REPLICATES, min_n=2)


@query("s7_f1_interval")
def s7_interval(spark, sf):
    return bootstrap.macro_f1_interval(_language_guesses(spark, sf), ["system"], "lang", "p", _F1_REPLICATES)


@query("s7_class_f1_interval")
def s7_class_interval(spark, sf):
    return bootstrap.class_f1_interval(_language_guesses(spark, sf), ["system"], "lang", "p", _F1_REPLICATES)


@query("s9_kappa_interval")
def s9_interval(spark, sf):
    return bootstrap.kappa_interval(_raters(spark, sf), "a", "b", ["lang"], _REPLICATES)


# ---- calibration and abstention -------------------------------------------------------------


@query(
    "s17_ece",
    f"""WITH {Q.PROBABILITIES}, b AS (SELECT ceil(confidence * 15) AS bin, count(*) AS n, avg(CAST(prediction = lang AS INTEGER)) AS acc, avg(confidence) AS conf FROM probabilities GROUP BY bin)
    SELECT sum(n)::BIGINT AS n, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b""",
)
def s17(spark, sf):
    rows = T.document_probabilities(spark, sf).withColumn("ok", (F.col("prediction") == F.col("lang")).cast("int"))
    return _rounded(calibration.expected_calibration_error(rows, "confidence", "ok"), ["ece"])


_LONG_P = """long AS (SELECT lang, (['de', 'en', 'es', 'fr'])[i] AS class, p[i] AS p, CASE WHEN (['de', 'en', 'es', 'fr'])[i] = lang THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM (SELECT lang, p, unnest(range(1, 5)) AS i FROM probabilities))"""


@query("s18_brier", f"WITH {Q.PROBABILITIES}, {_LONG_P} SELECT (SELECT count(*) FROM probabilities) AS n, round(avg(pow(p - y, 2)), 6) AS brier FROM long")
def s18(spark, sf):
    return _rounded(calibration.brier(T.document_probabilities(spark, sf), "probabilities", "lang", T.LANGS), ["brier"])


@query(
    "s19_reliability_curve",
    f"WITH {Q.PROBABILITIES}, {_LONG_P} SELECT class, least(9, floor(p * 10))::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS share_positive FROM long GROUP BY ALL",
)
def s19(spark, sf):
    out = calibration.reliability_curve(T.document_probabilities(spark, sf), "probabilities", "lang", T.LANGS)
    return _rounded(out, ["mean_p", "share_positive"])


_TAU_LIST = "(SELECT unnest([{}]::DOUBLE[]) AS tau)"
_CURVE = f"""{Q.PROBABILITIES}, covered AS (SELECT tau, lang AS t, prediction AS p, confidence >= tau AS inside FROM probabilities, {{taus}}),
sides AS (SELECT tau, t AS class, 1 AS support, 0 AS predicted, CAST(t = p AS INTEGER) AS hit FROM covered WHERE inside UNION ALL SELECT tau, p, 0, 1, 0 FROM covered WHERE inside),
f AS (SELECT tau, class, 2 * sum(hit) / sum(support + predicted)::DOUBLE AS f1 FROM sides GROUP BY tau, class),
curve AS (SELECT tau, n_covered, coverage, accuracy, macro_f1 FROM (SELECT tau, count(*) FILTER (WHERE inside) AS n_covered, avg(CAST(inside AS INTEGER)) AS coverage, avg(CAST(t = p AS INTEGER)) FILTER (WHERE inside) AS accuracy FROM covered GROUP BY tau)
  LEFT JOIN (SELECT tau, avg(f1) AS macro_f1 FROM f GROUP BY tau) USING (tau))"""


def _curve_sql(taus):
    return _CURVE.replace("{taus}", _TAU_LIST.format(", ".join(str(t) for t in taus)))


@query("s20_abstention", f"WITH {_curve_sql(calibration.TAUS)} SELECT tau, n_covered, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM curve")
def s20(spark, sf):
    out = calibration.abstention_curve(T.document_probabilities(spark, sf), "lang", "prediction", "confidence")
    return _rounded(out, ["coverage", "accuracy", "macro_f1"])


@query(
    "s21_select_tau",
    f"WITH {_curve_sql(calibration.SELECT_TAUS)} SELECT coalesce(max(tau) FILTER (WHERE accuracy >= 0.97 AND coverage >= 0.10), 0.5) AS largest, coalesce(min(tau) FILTER (WHERE accuracy >= 0.97 AND coverage >= 0.10), 0.5) AS smallest FROM curve",
)
def s21(spark, sf):
    p = T.document_probabilities(spark, sf)
    one = None
    for prefer in ["largest", "smallest"]:
        tau = calibration.select_tau(p, "lang", "prediction", "confidence", None, 0.97, 0.10, prefer=prefer)
        part = tau.select(F.col("tau").alias(prefer), F.lit(0).alias("k"))
        one = part if one is None else one.join(part, "k")
    return one.drop("k")


@query(
    "s22_tau_sweep",
    f"""WITH {Q.PAIRS}, r AS (SELECT 'learned' AS router, pred_learned AS p, conf_learned AS c, judge_answer, truth FROM pairs UNION ALL SELECT 'keyword', pred_keyword, conf_keyword, judge_answer, truth FROM pairs),
    s AS (SELECT router, tau, c >= tau AS inside, CASE WHEN c < tau THEN judge_answer = truth WHEN starts_with(p, 'SYMBOLIC') THEN true WHEN p = 'UNSUPPORTED' THEN truth = 'reject' ELSE judge_answer = truth END AS ok FROM r, {_TAU_LIST.format(", ".join(str(t) for t in [0.0, *calibration.TAUS]))})
    SELECT router, tau, round(avg(CAST(ok AS INTEGER)), 6) AS accuracy, round(avg(CAST(inside AS INTEGER)), 6) AS coverage, count(*) FILTER (WHERE NOT inside) AS n_fallback FROM s GROUP BY router, tau""",
)
def s22(spark, sf):
    rows = T.pairs(spark, sf).select("judge_answer", "truth", F.inline(_routers()))
    out = routing.tau_sweep(rows, "router", "predicted", "confidence", "judge_answer", "truth")
    return _rounded(out, ["accuracy", "coverage"])


def _routers():
    return F.array(
        *[
            F.struct(
                F.lit(r).alias("router"),
                F.col(f"pred_{r}").alias("predicted"),
                F.col(f"conf_{r}").alias("confidence"),
            )
            for r in ["learned", "keyword"]
        ]
    )


# ---- routing --------------------------------------------------------------------------------


@query("r1_fallback", f"WITH {Q.PAIRS} SELECT id, CASE WHEN conf_learned < 0.5 THEN 'SEMANTIC' ELSE pred_learned END AS calibrated, pred_learned AS uncalibrated FROM pairs")
def r1(spark, sf):
    p, c = F.col("pred_learned"), F.col("conf_learned")
    return T.pairs(spark, sf).select(
        "id",
        routing.with_fallback(p, c, 0.5).alias("calibrated"),
        routing.with_fallback(p, c, 0.5, calibrated=False).alias("uncalibrated"),
    )


@query("r2_routed", f"WITH {Q.ROUTED} SELECT id, routed_answer, routed_correct, keyword_answer FROM routed_pairs")
def r2(spark, sf):
    return T.routed_pairs(spark, sf).select("id", "routed_answer", "routed_correct", "keyword_answer")


@query("r3_strict", f"WITH {Q.ROUTED} SELECT id, strict_answer, strict_correct FROM routed_pairs")
def r3(spark, sf):
    return T.routed_pairs(spark, sf).select("id", "strict_answer", "strict_correct")


@query("r4_deployed", f"WITH {Q.ROUTED} SELECT id, deployed_answer, deployed_correct FROM routed_pairs")
def r4(spark, sf):
    return T.routed_pairs(spark, sf).select("id", "deployed_answer", "deployed_correct")


@query(
    "r5_routing_accuracy",
    f"""WITH {Q.PAIRS}, r AS (SELECT 'learned' AS router, category, CASE WHEN conf_learned < 0.5 THEN 'SEMANTIC' ELSE pred_learned END AS f, conf_learned < 0.5 AS fell FROM pairs UNION ALL SELECT 'keyword', category, pred_keyword, false FROM pairs)
    SELECT router, count(*) AS n_pairs, count(*) FILTER (WHERE f = category) AS n_correct, count(*) FILTER (WHERE f <> category) AS n_misrouted, count(*) FILTER (WHERE fell) AS n_fallback, round(avg(CAST(f = category AS INTEGER)), 6) AS accuracy
    FROM r WHERE starts_with(category, 'SYMBOLIC') GROUP BY router""",
)
def r5(spark, sf):
    rows = T.pairs(spark, sf).select("category", F.inline(_routers()))
    tau = F.when(F.col("router") == "learned", 0.5).otherwise(0.0)
    return _rounded(routing.routing_accuracy(rows, "router", "predicted", "confidence", "category", tau), ["accuracy"])


@query(
    "r6_optimistic",
    f"WITH {Q.PAIRS} SELECT id, CASE WHEN starts_with(pred_learned, 'SYMBOLIC') THEN true WHEN pred_learned = 'UNSUPPORTED' THEN truth = 'reject' ELSE judge_answer = truth END AS ok FROM pairs",
)
def r6(spark, sf):
    ok = routing.optimistic_correct(F.col("pred_learned"), F.col("judge_answer"), F.col("truth"))
    return T.pairs(spark, sf).select("id", ok.alias("ok"))


@query(
    "m16_ladder",
    f"""WITH {Q.LABELLED}, long AS ({Q.SYSTEM_ROWS}), a AS (SELECT system, avg(correct) AS score, CASE system WHEN 'random' THEN 1 WHEN 'length' THEN 2 WHEN 'words' THEN 3 ELSE 4 END AS step FROM long GROUP BY system)
    SELECT step, system, round(score, 6) AS score, coalesce(score >= lag(score) OVER (ORDER BY step), true) AS rises, CASE WHEN system = 'words' THEN score < 0.8 END AS gate_passed FROM a""",
)
def m16(spark, sf):
    long = metrics.to_long(T.labelled_documents(spark, sf), [], T.SYSTEMS)
    scores = metrics.accuracy_by(long, ["system"]).withColumnRenamed("accuracy", "score")
    step = F.when(F.col("system") == "random", 1).when(F.col("system") == "length", 2).when(F.col("system") == "words", 3).otherwise(4)
    out = calibration.ladder(scores.withColumn("step", step), "step", "system", "score", "words")
    return _rounded(out, ["score"])
