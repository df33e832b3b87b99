"""Bootstrap bounds against brute-force resampling of rows, and the widths the queries' checks allow."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from qaloom.operators import bootstrap, metrics
from qaloom.plans import catalogue
from qaloom.plans import evaluation_queries as queries

RNG = np.random.default_rng(8)
TRUTH = RNG.integers(0, 2, 80)
GUESS = np.where(RNG.random(80) < 0.75, TRUTH, 1 - TRUTH)


def kappa(a, b):
    po, pe = (a == b).mean(), a.mean() * b.mean() + (1 - a.mean()) * (1 - b.mean())
    return (po - pe) / (1 - pe)


def macro_f1(t, p):
    return np.mean([2 * ((t == c) & (p == c)).sum() / ((t == c).sum() + (p == c).sum()) for c in (0, 1)])


def resampled(value):
    draws = np.random.default_rng(9).integers(0, 80, (4000, 80))
    return np.percentile([value(TRUTH[d], GUESS[d]) for d in draws], [2.5, 97.5])


@pytest.fixture
def rows(spark):
    names = ["no", "yes"]
    data = [("s", names[t], names[g], int(t == g)) for t, g in zip(TRUTH, GUESS)]
    return spark.createDataFrame(data, "system string, lang string, p string, hit int")


def test_bounds_equal_resampled_rows(rows):
    found = {
        "mean": (bootstrap.mean_interval(rows, ["system"], "hit", 4000), lambda t, g: (t == g).mean()),
        "f1": (bootstrap.macro_f1_interval(rows, ["system"], "lang", "p", 4000), macro_f1),
        "kappa": (bootstrap.kappa_interval(rows, "lang", "p", ["system"], 4000), kappa),
    }
    for got, value in found.values():
        r = got.first()
        assert (r.ci_lo, r.ci_hi) == pytest.approx(tuple(resampled(value)), abs=0.03)


def test_a_useless_width_is_not_inside(rows):
    scores = metrics.class_scores(rows, "lang", "p", ["system"])
    raters = rows.select(F.lit("en").alias("lang"), F.col("lang").alias("a"), F.col("p").alias("b"))
    values = {
        "macro_f1": queries._macro_f1_errors(rows, scores).withColumn("macro_f1", F.lit(macro_f1(TRUTH, GUESS))),
        "f1": queries._class_f1_errors(scores).select("f1", "error", "rows"),
        "kappa": queries._kappa_errors(raters).withColumn("kappa", F.lit(kappa(TRUTH, GUESS))),
    }
    low, high = resampled(macro_f1)
    for name, df in values.items():
        whole = df.withColumns({"ci_lo": F.lit(-1.0 if name == "kappa" else 0.0), "ci_hi": F.lit(1.0)})
        point = df.withColumns({"ci_lo": F.col(name), "ci_hi": F.col(name)})
        assert not any(r.inside for r in queries._around(whole, name).collect())
        assert not any(r.inside for r in queries._around(point, name).collect())
    good = values["macro_f1"].withColumns({"ci_lo": F.lit(float(low)), "ci_hi": F.lit(float(high))})
    assert queries._around(good, "macro_f1").first().inside


def test_interval_queries_return_their_bounds(spark):
    sf = "/root/testdata/sf0.001"
    for name, value in {
        "s5_mean_interval": "accuracy", "s6_category_interval": "accuracy", "s7_f1_interval": "macro_f1",
        "s7_class_f1_interval": "f1", "s9_kappa_interval": "kappa",
    }.items():
        rows = catalogue.QUERIES[name](spark, sf).collect()
        assert rows and all(r.ci_lo is None or -1 <= r.ci_lo <= r.ci_hi <= 1 for r in rows), name
        assert any(r.ci_lo is not None and r.ci_lo <= r[value] <= r.ci_hi for r in rows), name
