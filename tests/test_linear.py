"""Stacked linear fits against plain gradients, single fits and in-row TF-IDF against plain counts."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from qaloom.operators import features, linear, models


def objective(fit, x, y, k, weights):
    """Loss over C * n and its slope by central differences' ingredients: a plain loop over rows."""
    n = np.bincount(y, minlength=k)
    balance = len(y) / ((n > 0).sum() * np.maximum(n, 1)) if fit.balanced else np.ones(k)
    total = 0.0
    for row, label in zip(x, y, strict=True):
        s = np.append(row, 1.0) @ weights
        if fit.loss == "logistic":
            total += balance[label] * (math.log(sum(math.exp(v) for v in s)) - s[label])
        else:
            for c in range(k):
                t = 1 if c == label else -1
                total += (balance[c] if t > 0 else 1.0) * max(0.0, 1 - t * s[c]) ** 2
    fined = weights[:-1] if fit.loss == "logistic" else weights
    return total / len(y) + (fined**2).sum() / (2 * fit.c * len(y))


def table(spark, seed=1, n=90, width=6, k=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    x = np.where(rng.random((n, width)) < 0.6, rng.normal(0, 1, (n, width)) + y[:, None] * (np.arange(width) % k == y[:, None]), 0.0)
    x[:3] = 0
    rows = [(int(i), np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist(), int(c), bool(i % 3), i % 3 == 0) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id bigint, indices array<int>, values array<double>, label int, most boolean, few boolean").repartition(4)
    return x, y, df


def test_all_fits_reach_their_own_minimum(spark, monkeypatch):
    x, y, df = table(spark)
    fits = {f"{loss}{c}{rows}{b}": linear.Fit(loss, c, rows, b) for loss in ("logistic", "svm") for c in (0.1, 3.0) for rows in (None, "most") for b in (True, False)}
    together = linear.fit_all(df, 6, 3, fits, tolerance=1e-6)
    monkeypatch.setattr(linear, "MATRIX", 7 * 3 * 5)  # groups of five, partial sums merged by Spark
    monkeypatch.setattr(linear, "DENSE", 20)
    assert all(np.allclose(m.weights, together[name].weights, atol=1e-4) for name, m in linear.fit_all(df, 6, 3, fits, tolerance=1e-6).items())
    for name, fit in fits.items():
        use = np.arange(len(y)) % 3 > 0 if fit.rows else np.ones(len(y), bool)
        assert together[name].converged
        w = together[name].weights
        best = objective(fit, x[use], y[use], 3, w)
        for at in np.ndindex(w.shape):
            step = np.zeros_like(w)
            step[at] = 1e-4
            slope = (objective(fit, x[use], y[use], 3, w + step) - objective(fit, x[use], y[use], 3, w - step)) / 2e-4
            assert abs(slope) < 1e-5
            step[at] = 0.05
            assert objective(fit, x[use], y[use], 3, w + step) > best


def test_no_rows_leave_the_weights_at_zero(spark):
    _, _, df = table(spark)
    empty = linear.fit_all(df.limit(0), 6, 3, {"a": linear.Fit("svm")})["a"]
    assert empty.converged and not empty.weights.any()


def test_a_fit_that_is_cut_short_says_so(spark):
    _, _, df = table(spark)
    with pytest.warns(UserWarning, match="did not converge"):
        assert not linear.fit_all(df, 6, 3, {"a": linear.Fit("logistic", 100.0)}, most=2)["a"].converged


def test_predictions_of_subsets(spark):
    x, y, df = table(spark)
    fitted = linear.fit_all(df, 6, 3, {"a": linear.Fit("logistic", 1.0, "most"), "b": linear.Fit("svm")})
    got = {(r.model, r.id): r for r in linear.predict_all(df, fitted, ["id", "label"], {"a": "few"}).collect()}
    assert {k for k in got if k[0] == "a"} == {("a", i) for i in range(0, 90, 3)} and sum(k[0] == "b" for k in got) == 90
    for (name, i), r in got.items():
        s = np.append(x[i], 1.0) @ fitted[name].weights
        assert r["class"] == s.argmax() and r.label == y[i]
        assert np.allclose(r.scores, np.exp(s) / np.exp(s).sum() if name == "a" else s)


def plain_terms(text, largest):
    w = re.findall(r"\w\w+", (text or "").lower())
    return Counter(w + [" ".join(w[i : i + n]) for n in range(2, largest + 1) for i in range(len(w) - n + 1)])


@pytest.mark.parametrize("largest,most", [(1, 1000), (2, 1000), (2, 12)])
def test_weights_in_the_row_equal_plain_tfidf(spark, largest, most):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["red", "green", "blue", "Größe", "x", "two words", "日本語", "seven 7"]) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").repartition(3)
    train = df.where("id < 40")
    counts = [plain_terms(t, largest) for t in texts]
    total, seen = Counter(), Counter()
    for c in counts[:40]:
        total.update(c)
        seen.update(c.keys())
    kept = sorted(sorted(total, key=lambda t: (-total[t], t.encode()))[:most])
    idf = {t: math.log(41 / (1 + seen[t])) + 1 for t in kept}
    expected = {}
    for i, c in enumerate(counts):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        length = math.sqrt(sum(v * v for v in raw.values()))
        expected |= {(i, t): v / length for t, v in raw.items()}
    got = {(r.id, r.term): r.weight for r in features.tfidf(train, df, "id", "t", most, largest).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v) for k, v in expected.items())
    rows, n = features.weighed(train, df, ["id"], "t", most, largest)
    assert n == len(kept) and rows.count() == len(texts)
    for r in rows.collect():
        assert {(r.id, kept[i]): pytest.approx(v) for i, v in zip(r.indices, r["values"], strict=True)} == {k: v for k, v in expected.items() if k[0] == r.id}


def test_weights_shuffle_no_terms(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "two three")], "id bigint, t string")
    plan = features.tfidf(df, df, "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_grid_has_one_row_per_entry(spark):
    kinds = {"time": "reply within minutes soon {}", "count": "more than messages sent {}", "tone": "was the agent kind {}"}
    rows = [(i, t.format(["a1", "b2", "c3"][i % 3]), k, i % 4 > 0) for i, (k, t) in enumerate(list(kinds.items()) * 16)]
    df = spark.createDataFrame(rows, "id bigint, prompt string, category string, train boolean").withColumn("test", ~F.col("train"))
    ready, n, labels = models.text_rows(df.where("train"), df, "category")
    got = {r.model: r for r in models.linear_grid(ready, n, labels, "id", "category", {"a": ("logistic", 1.0), "b": ("svm", 1.0), "c": ("svm", 0.01)}, 3).collect()}
    assert set(got) == {"a", "b", "c"} and all(r.n_folds == 3 and r.converged for r in got.values())
    assert got["a"].test_macro_f1 == got["b"].test_macro_f1 == 1.0 and got["a"].best and got["b"].best + got["c"].best == 1


def test_a_row_that_counts_often_is_that_many_rows(spark):
    _, _, df = table(spark)
    often = df.withColumn("copies", (F.col("id") % 4).cast("bigint") + 1)
    rows = often.select("*", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "col")
    fits = {"a": linear.Fit("logistic", 1.0, "most"), "b": linear.Fit("svm")}
    one, many = (linear.fit_all(x, 6, 3, fits, tolerance=1e-7) for x in (often, rows))
    assert all(np.allclose(one[name].weights, many[name].weights, atol=1e-5) for name in fits)


@pytest.mark.parametrize("filled", [0.001, 1000])
def test_entries_and_layouts_give_the_same_fits(spark, monkeypatch, filled):
    _, _, df = table(spark)
    expected = linear.fit_all(df, 6, 3, {"a": linear.Fit("svm")}, tolerance=1e-7)["a"].weights
    monkeypatch.setattr(linear, "DENSE", 30)
    index, values, row = np.array([0, 2, 2]), np.array([1.0, 2.0, 3.0]), np.array([0, 0, 2])
    matrix = np.arange(8.0).reshape(4, 2)
    for made in (linear._Dense, linear._Sparse):
        x, slope = made(index, values, row, 3, 4), np.zeros((4, 2))
        assert x.scores(matrix).tolist() == [[14.0, 18.0], [6.0, 7.0], [18.0, 22.0]]
        x.add(slope, np.ones((3, 2)))
        assert slope.tolist() == [[1.0, 1.0], [0.0, 0.0], [5.0, 5.0], [3.0, 3.0]]
    monkeypatch.setattr(linear, "FILLED", filled)
    assert np.allclose(linear.fit_all(df, 6, 3, {"a": linear.Fit("svm")}, tolerance=1e-7)["a"].weights, expected, atol=1e-5)


@pytest.mark.parametrize("largest,most", [(1, 4), (2, 1000), (2, 12)])
def test_terms_are_counted_as_often_as_their_rows(spark, monkeypatch, largest, most):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["red", "redder", "green", "Größe", "x", "two words", "日本語"]) for _ in range(rng.randrange(12))) for _ in range(60)] + [None]
    df = spark.createDataFrame([(t, 1 + i % 3) for i, t in enumerate(texts)], "t string, copies bigint").repartition(3)
    total, seen = Counter(), Counter()
    for i, t in enumerate(texts):
        for term, n in plain_terms(t, largest).items():
            total[term] += n * (1 + i % 3)
            seen[term] += 1 + i % 3
    kept = sorted(total, key=lambda t: (-total[t], t))[:most]
    expected = [(t, total[t], seen[t]) for t in kept]
    assert features.top_terms(df, "t", most, largest, "copies") == expected
    monkeypatch.setattr(features, "HELD", 5)
    monkeypatch.setattr(features, "FLUSH", 2)
    monkeypatch.setattr(features, "PIECE", 7)
    assert features.top_terms(df, "t", most, largest, "copies") == expected
    monkeypatch.setattr(features, "KNOWN", 1)
    assert features.top_terms(df, "t", most, largest, "copies") == expected


def test_a_step_lays_out_no_product_of_entries_and_columns(spark):
    rng = np.random.default_rng(2)
    n, each, width, columns = 2000, 30, 5000, 60
    index = np.concatenate([np.sort(rng.choice(width - 1, each, replace=False)) for _ in range(n)])
    values, row = rng.normal(size=n * each), np.repeat(np.arange(n), each)
    matrix, slopes = rng.normal(size=(width, columns)), rng.normal(size=(n, columns))
    laid = np.zeros((n, width))
    laid[row, index], laid[:, -1] = values, 1.0
    x, slope = linear._Sparse(index, values, row, n, width), np.zeros_like(matrix)
    tracemalloc.start()
    scores = x.scores(matrix)
    x.add(slope, slopes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(scores, laid @ matrix) and np.allclose(slope, laid.T @ slopes)
    assert most < n * each * columns * 8 / 4


def test_a_step_returns_a_matrix_for_each_core_and_leaves_no_shuffle(spark, monkeypatch):
    _, _, df = table(spark)
    seen, step = [], linear._pass
    monkeypatch.setattr(linear, "_pass", lambda rows, tasks, *rest: seen.append((tasks, rows.rdd.getNumPartitions())) or step(rows, tasks, *rest))
    monkeypatch.setattr(linear, "MATRIX", 7 * 3 * 5)  # partial sums are merged by Spark
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    many = linear.fit_all(df.repartition(23), 6, 3, {"a": linear.Fit("svm")})["a"]
    assert set(seen) == {(spark.sparkContext.defaultParallelism,) * 2} and spark.conf.get(name) == before
    assert np.allclose(many.weights, linear.fit_all(df, 6, 3, {"a": linear.Fit("svm")})["a"].weights, atol=1e-6)


def test_folds_alone_fit_no_whole_model(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, f"{'red' if i % 2 else 'blue'} {rng.choice(['tea', 'sea'])}", "ab"[i % 2], True, i % 4 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, prompt string, kind string, train boolean, test boolean")
    ready, n, labels = models.text_rows(df, df, "kind")
    seen, fit_all = [], linear.fit_all
    monkeypatch.setattr(linear, "fit_all", lambda rows, n, k, fits: seen.append(sorted(fits)) or fit_all(rows, n, k, fits))
    folds = models.linear_grid(ready, n, labels, "id", "kind", {"a": ("logistic", 1.0)}, test=None).first()
    whole = models.linear_grid(ready, n, labels, "id", "kind", {"a": ("logistic", 1.0)}).first()
    assert seen == [[f"a#{i}" for i in range(5)], [*(f"a#{i}" for i in range(5)), "a#test"]]
    assert folds.converged and folds.test_macro_f1 is None and whole.test_macro_f1 is not None
    assert all(folds[c] == pytest.approx(whole[c]) for c in ("n_folds", "mean_macro_f1", "std_macro_f1"))
