"""Statistics against known values, and against published numbers recomputed from counts."""

import math

import pytest
from pyspark.sql import functions as F

from qaloom.functions import tails
from qaloom.operators import agreement, bootstrap, calibration, metrics, repeats, routing, significance


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x", [0.0, 0.3, 3.841459, 10.827566, 40.0, 79.0, 500.0])
def test_chi_square_tail(spark, x):
    expected = math.erfc(math.sqrt(x / 2))
    assert value(spark, tails.chi2_tail_1(F.lit(x))) == pytest.approx(expected, abs=1e-14)
    assert tails._chi2_upper(x, 1.0) == pytest.approx(expected, rel=1e-9, abs=1e-300)


def test_known_quantiles():
    assert tails._t_quantile(0.95, 4.0) == pytest.approx(2.7764451051977987, rel=1e-9)
    assert tails._t_two_sided(2.228138851964939, 10.0) == pytest.approx(0.05, rel=1e-9)
    assert tails._t_two_sided(0.0, 3.0) == pytest.approx(1.0)
    assert tails._chi2_upper(16.918977604620448, 9.0) == pytest.approx(0.05, rel=1e-9)
    assert tails._t_two_sided(1.959963984540054, 1e9) == pytest.approx(0.05, rel=1e-5)


def test_mcnemar_edges(spark):
    def chi2(b, c):
        return value(spark, significance.mcnemar_statistic(F.lit(b), F.lit(c)))

    assert chi2(0, 0) == 0.0
    assert chi2(5, 5) == pytest.approx(0.1)
    # The published comparison of the deployed router with the judge has this statistic.
    assert chi2(88, 0) == pytest.approx(86.011, abs=1e-3)


def test_holm_is_monotone(spark):
    rows = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)]
    out = significance.holm(spark.createDataFrame(rows, "t string, p double"), "p")
    got = {r.t: r.p_holm for r in out.collect()}
    assert got == pytest.approx({"d": 0.02, "a": 0.03, "c": 0.06, "b": 0.06})


def test_kappa_by_hand(spark):
    # 20 both yes, 5 yes/no, 10 no/yes, 15 both no: po = .7, pe = .5, kappa = .4
    rows = [("yes", "yes")] * 20 + [("yes", "no")] * 5 + [("no", "yes")] * 10 + [("no", "no")] * 15
    df = spark.createDataFrame(rows, "a string, b string")
    row = agreement.kappa(df, "a", "b").first()
    assert (row.n, row.agreement, row.expected) == (50.0, pytest.approx(0.7), pytest.approx(0.5))
    assert row.kappa == pytest.approx(0.4) and row.pabak == pytest.approx(0.4)
    same = spark.createDataFrame([("yes", "yes")] * 3, "a string, b string")
    assert agreement.kappa(same, "a", "b").first().kappa is None


def test_f1_counts_classes_of_truth_and_prediction(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "c")]
    df = spark.createDataFrame(rows, "t string, p string")
    scores = {r["class"]: (r.precision, r.recall, r.f1) for r in metrics.class_scores(df, "t", "p").collect()}
    assert scores == {"a": (1.0, 0.5, pytest.approx(2 / 3)), "b": (0.0, 0.0, 0.0), "c": (0.0, 0.0, 0.0)}
    overall = metrics.overall_scores(metrics.class_scores(df, "t", "p")).first()
    assert overall.macro_f1 == pytest.approx(2 / 9) and overall.accuracy == pytest.approx(1 / 3)


def test_confidence_bins_at_the_edges(spark):
    got = [value(spark, calibration.confidence_bin(F.lit(c), 15)) for c in [0.0, 1 / 15, 1 / 15 + 1e-12, 1.0]]
    assert got == [None, 0, 1, 14]


def test_two_by_two_chi_square_is_corrected(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 5}
    rows = [k for k, n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "r string, c string")
    row = significance.chi2_independence(df, "r", "c").first()
    n, expected = 65, 0.0
    for (r, c), seen in cells.items():
        e = sum(v for k, v in cells.items() if k[0] == r) * sum(v for k, v in cells.items() if k[1] == c) / n
        expected += (abs(seen - e) - 0.5) ** 2 / e
    assert row.dof == 1 and row.chi2 == pytest.approx(expected)


def test_absent_cells_count_in_larger_tables(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("c", "y"): 5, ("c", "x"): 5}
    rows = [k for k, n in cells.items() for _ in range(n)]
    row = significance.chi2_independence(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    n, expected = 70, 0.0
    for r in "abc":
        for c in "xy":
            e = sum(v for k, v in cells.items() if k[0] == r) * sum(v for k, v in cells.items() if k[1] == c) / n
            expected += (cells.get((r, c), 0) - e) ** 2 / e
    assert row.dof == 2 and row.chi2 == pytest.approx(expected)


def test_policies_differ_on_misroutes(spark):
    rows = [
        ("SYMBOLIC_COUNT", "SYMBOLIC_TIME", '{"threshold": 5, "unit": "min", "operator": "<="}', "yes"),
        ("UNSUPPORTED", "SEMANTIC", None, "yes"),
        ("SEMANTIC", "SEMANTIC", None, "no"),
    ]
    df = spark.createDataFrame(rows, "predicted string, category string, params string, judge string")
    df = df.withColumns(
        {
            "response_minutes": F.lit(3.0),
            "n_public": F.lit(4).cast("bigint"),
            "tags": F.array(F.lit("x")),
            "channel": F.lit("chat"),
            "has_notes": F.lit(False),
            "prompt": F.lit("within 5 min"),
        }
    )
    p, c, params, j = (F.col(x) for x in ["predicted", "category", "params", "judge"])
    got = df.select(
        routing.routed(p, params, j).alias("routed"),
        routing.routed_strict(p, c, params, j).alias("strict"),
        routing.routed_deployed(p, c, F.col("prompt"), params, j).alias("deployed"),
        routing.optimistic_correct(p, j, F.lit("no")).alias("optimistic"),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("yes", "invalid", "yes", True),
        ("reject", "reject", "reject", False),
        ("no", "no", "no", True),
    ]


def test_missing_stored_answers_fail_in_replay(spark):
    rows = spark.createDataFrame([(1, "k1"), (2, "k2")], "id bigint, key string")
    stored = spark.createDataFrame([("k1", "yes", 5, 1.0)], "cache_key string, answer string, tokens bigint, latency_ms double")
    kept = routing.lookup_answers(rows, stored, "key", strict=False).orderBy("id").collect()
    assert [r.judge_answer for r in kept] == ["yes", None]
    with pytest.raises(Exception, match="no stored answer"):
        routing.lookup_answers(rows, stored, "key").collect()


def test_repeat_runs(spark):
    rows = [("m", 1, "yes", 1), ("m", 1, "no", 0), ("m", 2, "yes", 1), ("m", 2, "yes", 1)]
    runs = spark.createDataFrame(rows, "model string, idx bigint, answer string, correct int")
    items = repeats.answer_counts(runs, ["model", "idx"], "answer", "correct")
    row = repeats.inconsistency(items, ["model"]).first()
    assert (row.n_items, row.n_inconsistent, row.accuracy) == (2, 1, 0.75)


# Label-pair counts of the published annotation study (120 prompts, two raters and the key).
H, S, C, M, T, U = "HYBRID SEMANTIC SYMBOLIC_COUNT SYMBOLIC_METADATA SYMBOLIC_TIME UNSUPPORTED".split()
BETWEEN = [
    (H, H, 13), (H, S, 3), (H, C, 2), (H, U, 3), (S, H, 1), (S, S, 28), (S, C, 2), (S, M, 1), (S, U, 3),
    (C, S, 1), (C, C, 13), (C, M, 1), (C, U, 1), (M, M, 17), (T, T, 17), (U, S, 2), (U, U, 12),
]
FIRST = [
    (H, H, 15), (H, S, 1), (H, C, 2), (H, U, 3), (S, H, 4), (S, S, 19), (S, C, 5), (S, M, 1), (S, T, 3),
    (S, U, 3), (C, C, 13), (C, M, 2), (C, U, 1), (M, M, 17), (T, T, 17), (U, H, 1), (U, U, 13),
]
SECOND = [
    (H, H, 14), (S, H, 6), (S, S, 20), (S, C, 3), (S, M, 1), (S, T, 3), (S, U, 1), (C, C, 17), (M, M, 19),
    (T, T, 17), (U, U, 19),
]


def rows_of(spark, counts):
    rows = [(a, b) for a, b, n in counts for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


@pytest.mark.parametrize("counts, expected", [(BETWEEN, 0.796), (FIRST, 0.74), (SECOND, 0.86)])
def test_published_kappas(spark, counts, expected):
    assert agreement.kappa(rows_of(spark, counts), "a", "b").first().kappa == pytest.approx(expected, abs=5e-4)


def test_published_agreement_and_interval(spark):
    rows = rows_of(spark, BETWEEN)
    row = agreement.kappa(rows, "a", "b").first()
    assert row.agreement == pytest.approx(0.8333, abs=5e-5) and row.band == "Substantial"
    interval = bootstrap.kappa_interval(rows, "a", "b", replicates=1500).first()
    assert interval.ci_lo == pytest.approx(0.707, abs=0.015)
    assert interval.ci_hi == pytest.approx(0.8704, abs=0.015)
