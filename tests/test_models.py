"""Router models: calibration, ensembles, stored pipelines and baselines on small data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from qaloom.operators import features, models, perceptron
from qaloom.plans import model_queries
from qaloom.session import shared_folder


def probabilities(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        x = rng.random()
        rows.append((i, "a" if rng.random() < 1 / (1 + math.exp(-(4 * x - 1))) else "b", [x, 1 - x]))
    return rows, spark.createDataFrame(rows, "id bigint, t string, probabilities array<double>")


def test_platt_reaches_the_stationary_point(spark):
    rows, df = probabilities(spark)
    fits = models.fit_platt(df, "t", ["a", "b"])
    for i, name in enumerate(["a", "b"]):
        slope, start = fits[i]
        yes = sum(r[1] == name for r in rows)
        high, low = (yes + 1) / (yes + 2), 1 / (len(rows) - yes + 2)
        gaps = [1 / (1 + math.exp(-(slope * r[2][i] + start))) - (high if r[1] == name else low) for r in rows]
        assert abs(sum(gaps)) < 1e-3
        assert abs(sum(g * r[2][i] for g, r in zip(gaps, rows))) < 1e-3
    out = models.apply_platt(df, fits, ["a", "b"]).collect()
    assert all(sum(r.probabilities) == pytest.approx(1.0) for r in out)
    assert all(r.prediction in "ab" and r.confidence == max(r.probabilities) for r in out)


def test_ensemble_averages_by_key(spark):
    a = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.4, 0.6])], "id bigint, probabilities array<double>")
    b = spark.createDataFrame([(2, [0.8, 0.2]), (1, [0.2, 0.8])], "id bigint, probabilities array<double>")
    got = {r.id: (r.prediction, round(r.confidence, 6)) for r in models.ensemble(a, b, ["id"], ["x", "y"]).collect()}
    assert got == {1: ("x", 0.55), 2: ("x", 0.6)}


def prompts(spark):
    kinds = {"time": "reply within {} minutes", "count": "more than {} messages sent", "tone": "was the agent {} kind"}
    rows = [(i, t.format(i), k) for i, (k, t) in enumerate(list(kinds.items()) * 12)]
    return spark.createDataFrame(rows, "id bigint, prompt string, category string")


def test_a_stored_pipeline_masks_what_it_scores(spark):
    df = prompts(spark)
    model, labels = models.fit(df, "category", "bayes")
    path = f"{shared_folder(spark)}/test-router"
    model.write().overwrite().save(path)
    again = models.score_stored(path, labels, df.withColumn("prompt", F.replace("prompt", F.lit("1"), F.lit("77"))), ["id"], "category")
    assert {r.category: r.accuracy for r in again.collect()} == {"time": 1.0, "count": 1.0, "tone": 1.0}


def test_benchmark_and_folds_have_one_row_each(spark):
    df = prompts(spark)
    out = models.benchmark(df, {"test": df}, "id", "category", {"m": {"kind": "bayes"}, "clean": {"kind": "bayes", "rows": F.col("id") > 3}})
    assert {(r.set, r.model) for r in out.collect()} == {("test", "m"), ("test", "clean")}
    cv = models.cross_validated(df, "id", "category", {"a": {"kind": "bayes"}}, 3).first()
    assert cv.n_folds == 3 and cv.mean_macro_f1 > 0.9


def test_grouped_bayes_agrees_with_the_library(spark):
    df = prompts(spark)
    grouped = features.naive_bayes(df, df, "id", "prompt", "category")
    joined = grouped.join(df, "id")
    assert joined.where(F.col("prediction") == F.col("category")).count() == df.count()
    empty = features.naive_bayes(df, df.withColumn("prompt", F.lit("?")), "id", "prompt", "category")
    assert {round(r.score, 6) for r in empty.collect()} == {round(math.log(1 / 3), 6)}


def test_ngrams_of_short_texts(spark):
    rows = spark.createDataFrame([("One two three",), ("one",), ("",)], "t string")
    got = [r[0] for r in rows.select(features.ngrams(F.col("t"), 2)).collect()]
    assert got == [["one", "two", "three", "one two", "two three"], ["one"], []]


def test_platt_ends_where_losses_differ_by_rounding_alone(spark):
    names, rows = list("abcdefghijkl"), []
    for i in range(600):
        sure = 1 / (1 + math.exp(-(i * 37 % 101 - 15) / 6))
        said = names[(i + (i * 37 % 101 % 9 == 0)) % 12]
        rows.append((names[i % 12], [sure if c == said else (1 - sure) / 11 for c in names]))
    df = spark.createDataFrame(rows, "t string, probabilities array<double>").coalesce(1)
    assert all(slope > 0 > start for slope, start in models.fit_platt(df, "t", names, rounds=20))


@pytest.mark.parametrize("kind", ["bayes", "logistic"])
def test_equal_texts_are_one_row_of_a_fit(spark, kind):
    df = prompts(spark).select("*", F.explode(F.sequence(F.lit(1), F.col("id").cast("int") % 5 + 1))).drop("col")
    once = models.collapsed_texts(df, "prompt", ["category"])
    assert once.count() == 3 and once.agg(F.sum("copies")).first()[0] == df.count()
    model, labels = models.fit(df, "category", kind)
    again, _ = models.fit(once, "category", kind)
    rows = [
        {r.prompt: r.probabilities for r in models.predict(m, labels, once, ["prompt"]).collect()} for m in (model, again)
    ]
    assert rows[0].keys() == rows[1].keys() and all(rows[0][p] == pytest.approx(rows[1][p], abs=1e-6) for p in rows[0])
    idf = next(s for s in model.stages if type(s).__name__ == "ElementwiseProduct").getScalingVec().toArray()
    words = next(s for s in model.stages if type(s).__name__ == "CountVectorizerModel").vocabulary
    seen = df.where(F.col("prompt").contains("reply")).count()
    assert idf[words.index("reply")] == pytest.approx(math.log((df.count() + 1) / (seen + 1)))


def test_repeated_prompts_are_fitted_and_scored_once(spark, monkeypatch):
    rows = [(f, c) for c in ("time", "count") for f in ("a", "b")]
    df = spark.createDataFrame([(i * 40 + j, f"{c} is {f} or not {j}", c, f) for i, (f, c) in enumerate(rows) for j in range(6 + i)], "id bigint, prompt string, category string, family string")
    seen, found = [], models.predict
    monkeypatch.setattr(models, "predict", lambda m, labels, part, *rest: seen.append(part.count()) or found(m, labels, part, *rest))
    got = {(r.category, r.held_out): (r.n_test, r.accuracy) for r in models.family_out(df, "id", "category", "family", ["time", "count"], "bayes").collect()}
    assert {k: v[0] for k, v in got.items()} == {("time", "a"): 6, ("time", "b"): 7, ("count", "a"): 8, ("count", "b"): 9}
    assert all(v[1] in (0.0, 1.0) for v in got.values()) and seen == [1, 1, 1, 1]


def test_folds_store_each_text_once_and_no_terms(spark, monkeypatch):
    df = prompts(spark).unionByName(prompts(spark).withColumn("id", F.col("id") + 100))
    stored, checkpoint = [], models.checkpoint
    monkeypatch.setattr(models, "checkpoint", lambda rows: stored.append(checkpoint(rows)) or stored[-1])
    got, labels = models.calibrated_by_folds(df, df.where("id < 12"), "id", "category", ["id", "category"])
    assert got.count() == 12 and all(sum(r.probabilities) == pytest.approx(1.0) and labels[r.probabilities.index(max(r.probabilities))] == r.category for r in got.collect())
    assert not any("array<string>" in t for rows in stored for _, t in rows.dtypes)
    texts = [rows for rows in stored if "prompt" in rows.columns and "id" not in rows.columns]
    assert len(texts) == 1 and texts[0].count() == 3 and texts[0].agg(F.sum(F.expr("__n0 + __n1 + __n2"))).first()[0] == df.count()


def test_platt_counts_copies(spark):
    _, df = probabilities(spark, 60)
    df = df.withColumn("copies", F.col("id") % 3 + 1)
    repeated = df.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "again")
    assert sum(models.fit_platt(df, "t", ["a", "b"]), ()) == pytest.approx(sum(models.fit_platt(repeated, "t", ["a", "b"]), ()), abs=1e-4)


def test_the_benchmark_has_the_ten_published_routers(spark):
    routers = model_queries.ROUTERS
    kinds = [(r["kind"], r.get("features", "text")) for r in routers.values()]
    assert len(routers) == 10 and {("keyword", "text"), ("svm", "text"), ("boosted", "embedding"), ("perceptron", "embedding"), ("ensemble", "text")} <= set(kinds)
    assert routers["embedding_boosted"]["trees"] == 200 and perceptron.MOST == 500
    df = prompts(spark)
    asked = df.where("id < 9").unionByName(spark.createDataFrame([(99, "more than 3 messages sent", "unheard")], df.schema))
    few = routers | {"embedding_boosted": routers["embedding_boosted"] | {"trees": 2}}
    out = {r.model: r for r in models.benchmark(df, {"test": df.where("id < 9")}, "id", "category", few).collect()}
    assert out.keys() == routers.keys() and all(r.n == 9 for r in out.values())
    assert all(r.accuracy == 1.0 for name, r in out.items() if name != "keyword") and out["keyword"].accuracy == 0.0
    some = {r.model: r for r in models.benchmark(df, {"test": asked}, "id", "category", {k: few[k] for k in ("svm", "bayes", "embedding_logistic", "embedding_perceptron")}).collect()}
    assert all(r.n == 10 and r.accuracy == pytest.approx(0.9) for r in some.values())


def test_perceptron_counts_copies_and_stops_early(spark):
    rng = random.Random(6)
    rows = [([rng.gauss(2.0 * (i % 2), 0.3), rng.random()], i % 2, 1 + i % 3, int(i % 5 < 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "embedding array<double>, label int, copies bigint, held bigint")
    repeated = df.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumns({"copies": F.lit(1).cast("bigint"), "held": F.lit(0).cast("bigint")}).drop("again")
    unheld = df.withColumn("held", F.lit(0).cast("bigint"))
    once, again = (perceptron.fit(d, 2, 2, (4,), most=5) for d in (unheld, repeated))
    assert all((a - b).max() < 1e-6 for a, b in zip(once, again, strict=True))
    steps, step = [], perceptron._pass
    perceptron._pass = lambda *a: steps.append(1) or step(*a)
    try:
        layers = perceptron.fit(df, 2, 2)
    finally:
        perceptron._pass = step
    found = perceptron.predict(df, layers, ["0", "1"], ["label"]).where("prediction = cast(label AS string)").count()
    assert found == 40 and len(steps) < 60
