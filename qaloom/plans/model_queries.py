"""Queries that train routers. Without an SQL oracle unless they only count rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from qaloom.functions import text
from qaloom.operators import calibration, curation, features, linear, metrics, models
from qaloom.plans import sql as Q
from qaloom.plans import tables as T
from qaloom.plans.registry import query
from qaloom.schemas import SYMBOLIC
from qaloom.session import checkpoint, shared_folder


def _documents(spark, sf):
    docs = checkpoint(T.split_documents(spark, sf).withColumnRenamed("text", "prompt"))
    return tuple(docs.where(F.col("split") == s) for s in ["train", "val", "test"])


def _vectors(spark, sf):
    rows = T.table(spark, sf, "embeddings").withColumn("class", F.concat(F.lit("c"), "label"))
    rows = checkpoint(curation.stratified_split(rows.drop("label"), "class", "vec_id"))
    return tuple(rows.where(F.col("split") == s) for s in ["train", "val", "test"])


def _prompts(spark, sf, noisy: bool = False):
    rows = T.noisy_prompts(spark, sf) if noisy else T.prompt_table(spark, sf)
    rows = checkpoint(curation.stratified_split(rows, "category", "id"))
    return tuple(rows.where(F.col("split") == s) for s in ["train", "val", "test"])


def _text_scores(spark, sf, kind, **options):
    train, _, test = _documents(spark, sf)
    model, labels = models.fit(train, "lang", kind, **options)
    scored = models.predict(model, labels, models.collapsed_texts(test, "prompt", ["lang"]), ["lang", "copies"])
    return models.scores_of(scored, "lang").drop("tp")


def _vector_scores(spark, sf, kind, **options):
    train, _, test = _vectors(spark, sf)
    model, labels = models.fit(train, "class", kind, "embedding", "embedding", **options)
    scored = models.predict(model, labels, test, ["vec_id", "class"], "embedding", "embedding")
    scores = metrics.class_scores(scored.withColumnRenamed("class", "truth"), "truth", "prediction")
    return scores.drop("tp")


@query(
    "m3_embedding_features",
    "SELECT vec_id, len(embedding) AS n_dims, 1.0::DOUBLE AS length, round(embedding[1] / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings",
)
def m3(spark, sf):
    """The given vectors, scaled by their id so that lengths differ before they are made equal."""
    from pyspark.ml.functions import vector_to_array

    rows = T.table(spark, sf, "embeddings")
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)))
    rows = rows.select("vec_id", vector_to_array(features.embedding_vector("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select(
        "vec_id", F.size("v").cast("bigint").alias("n_dims"), F.round(F.sqrt(total), 4).alias("length"), F.round(F.get("v", F.lit(0)), 6).alias("first")
    )


@query("a8_missing_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def a8(spark, sf):
    stored = T.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return features.check_embeddings(T.table(spark, sf, "documents"), stored, "doc_id")


@query(
    "m4_class_weights",
    "SELECT lang, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*))::DOUBLE, 6) AS weight, count(*) AS n FROM documents GROUP BY lang",
)
def m4_weights(spark, sf):
    rows = features.class_weights(T.table(spark, sf, "documents").select("doc_id", "lang"), "lang")
    return rows.groupBy("lang", F.round("weight", 6).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def _linear_scores(spark, sf, loss):
    """Scores of one linear model on the test documents: TF-IDF with sublinear, smoothed weights."""
    train, _, test = _documents(spark, sf)
    marked = train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))
    marked = checkpoint(models.collapsed_texts(marked, "prompt", ["lang", "train"]))
    rows, n, labels = models.text_rows(marked.where("train"), marked, "lang")
    fits = linear.fit_all(rows.where("train"), n, len(labels), {loss: linear.Fit(loss)})
    scored = models.linear_predictions(rows.where("NOT train"), fits, labels, ["lang", "copies"])
    return models.scores_of(scored, "lang").drop("tp")


@query("m4_logreg_text")
def m4(spark, sf):
    return _linear_scores(spark, sf, "logistic")


@query("m4_logreg_embedding")
def m4_embedding(spark, sf):
    return _vector_scores(spark, sf, "logistic")


@query("m5_svm")
def m5(spark, sf):
    return _linear_scores(spark, sf, "svm")


@query("m6_bayes_model")
def m6_model(spark, sf):
    return _text_scores(spark, sf, "bayes")


@query("m7_forest")
def m7_forest(spark, sf):
    return _vector_scores(spark, sf, "forest")


@query("m7_boosted")
def m7(spark, sf):
    """Boosted trees, one class against the rest."""
    return _vector_scores(spark, sf, "boosted")


@query("m8_perceptron")
def m8(spark, sf):
    return _vector_scores(spark, sf, "perceptron")


@query("m9_platt")
def m9(spark, sf):
    """Calibration error before and after Platt scaling on the validation split."""
    train, validation, test = _documents(spark, sf)
    model, labels = models.fit(train, "lang", "logistic")
    keep = ["doc_id", "lang"]
    platt = models.fit_platt(models.predict(model, labels, validation, keep), "lang", labels)
    before = models.predict(model, labels, test, keep)
    after = models.apply_platt(before, platt, labels)
    both = before.withColumn("stage", F.lit("raw")).unionByName(after.withColumn("stage", F.lit("platt")))
    both = checkpoint(both.withColumn("ok", (F.col("lang") == F.col("prediction")).cast("int")))
    ece = calibration.expected_calibration_error(both, "confidence", "ok", ["stage"])
    return ece.join(calibration.brier(both, "probabilities", "lang", labels, ["stage"]).drop("n"), "stage")


@query("m10_ensemble")
def m10(spark, sf):
    """Average of two calibrated logistic models, one on terms and one on word-hash embeddings of all documents."""
    docs = T.split_documents(spark, sf).withColumnRenamed("text", "prompt")
    hashed = checkpoint(models.word_hashes(docs, "prompt").select("doc_id", "lang", "split", "embedding"))
    train, test = (F.col("split") == s for s in ("train", "test"))
    keep = ["doc_id", "lang"]
    first, labels = models.calibrated_by_folds(docs.where(train), docs.where(test), "doc_id", "lang", keep)
    second, _ = models.calibrated_by_folds(hashed.where(train), hashed.where(test), "doc_id", "lang", keep, features="embedding", text="embedding")
    scored = models.ensemble(first, second, keep, labels)
    return metrics.class_scores(scored, "lang", "prediction").drop("tp")


# The configurations of the published benchmark.
ROUTERS = {
    "keyword": {"kind": "keyword"},
    "logistic": {"kind": "logistic"},
    "logistic_unigram": {"kind": "logistic", "largest": 1},
    "logistic_digits": {"kind": "logistic", "mask": False},
    "svm": {"kind": "svm"},
    "bayes": {"kind": "bayes"},
    "embedding_logistic": {"kind": "logistic", "features": "embedding"},
    "embedding_boosted": {"kind": "boosted", "features": "embedding", "trees": 200, "parallel": 8},
    "embedding_perceptron": {"kind": "perceptron", "features": "embedding"},
    "ensemble": {"kind": "ensemble"},
}


@query("m12_benchmark")
def m12(spark, sf):
    """The ten routers of the published benchmark on the clean test prompts and on their noisy forms; embeddings are hashed words."""
    train, _, test = _prompts(spark, sf)
    _, _, noisy = _prompts(spark, sf, noisy=True)
    return models.benchmark(train, {"test": test, "holdout": noisy}, "id", "category", ROUTERS)


def _split_marks(rows, key, label):
    rows = curation.stratified_split(rows, label, key)
    return checkpoint(rows.withColumns({"train": F.col("split") == "train", "test": F.col("split") == "test"}).drop("split"))


@query("m13_grid")
def m13(spark, sf):
    """Logistic models and SVMs on texts, logistic models on vectors: all of each grid, five folds and the test rows."""
    docs = _split_marks(T.documents(spark, sf).select("doc_id", "text", "lang").withColumnRenamed("text", "prompt"), "doc_id", "lang")
    docs = docs.withColumn("fold", models.cv_fold("doc_id"))
    docs = checkpoint(models.collapsed_texts(docs, "prompt", ["lang", "train", "test", "fold"]))
    rows, n, labels = models.text_rows(docs.where("train"), docs, "lang")
    grid = {f"text_{loss}_{c:g}": (loss, c) for loss in ("logistic", "svm") for c in (0.1, 0.3, 1.0, 3.0, 10.0)}
    texts = models.linear_grid(rows, n, labels, "doc_id", "lang", grid)
    vectors = T.table(spark, sf, "embeddings").select("vec_id", "embedding", F.concat(F.lit("c"), "label").alias("class"))
    vectors = _split_marks(vectors.withColumnRenamed("class", "kind"), "vec_id", "kind")
    rows, n, labels = models.vector_rows(vectors.where("train"), vectors, "kind")
    grid = {f"vector_logistic_{c:g}": ("logistic", c) for c in (0.1, 0.3, 1.0, 3.0, 10.0, 30.0)}
    return texts.unionByName(models.linear_grid(rows, n, labels, "vec_id", "kind", grid))


@query("m14_separability")
def m14(spark, sf):
    """Five folds over all documents: logistic models on words and word pairs, and on 5,000 words alone."""
    docs = T.documents(spark, sf).select("lang", F.col("text").alias("prompt"), models.cv_fold("doc_id").alias("fold"))
    docs = models.collapsed_texts(docs, "prompt", ["lang", "fold"], mask=False)
    docs, out = checkpoint(docs.withColumn("train", F.lit(True))), None
    for name, shape in {"bigram": {}, "unigram": {"max_terms": 5000, "largest": 1}}.items():
        rows, n, labels = models.text_rows(docs, docs, "lang", mask=False, **shape)
        part = models.linear_grid(rows, n, labels, "doc_id", "lang", {name: ("logistic", 1.0)}, test=None, balanced=False)
        part = part.select("model", "n_folds", "mean_macro_f1", "std_macro_f1")
        out = part if out is None else out.unionByName(part)
    return out


@query("m15_noise_mix")
def m15(spark, sf):
    """SVM and logistic model trained on all, on clean and on noisy prompts, and their distance to the model of all."""
    train, _, test = _prompts(spark, sf, noisy=True)
    out = None
    for name, part in {"mixed": train, "clean_only": train.where("noise = 'none'"), "noisy_only": train.where("noise <> 'none'")}.items():
        part, asked = (checkpoint(models.collapsed_texts(x, "prompt", ["category"])) for x in (part, test))
        rows, n, labels = models.text_rows(part, part.withColumn("fit", F.lit(True)).unionByName(asked.withColumn("fit", F.lit(False))), "category")
        fits = linear.fit_all(rows.where("fit"), n, len(labels), {loss: linear.Fit(loss) for loss in ("svm", "logistic")})
        found = models.linear_predictions(rows.where("NOT fit"), fits, labels, ["category", "copies"])
        scores = metrics.overall_scores(models.scores_of(found, "category", ["model"]), ["model"])
        scores = scores.select(F.lit(name).alias("subset"), "model", "n", "accuracy", "macro_f1")
        out = scores if out is None else out.unionByName(scores)
    whole = Window.partitionBy("model")  # three rows a model
    return out.withColumn("delta", F.col("macro_f1") - F.max(F.when(F.col("subset") == "mixed", F.col("macro_f1"))).over(whole))


@query("m17_stored_model")
def m17(spark, sf):
    """A stored pipeline, loaded back and applied to prompts of another generator."""
    train, _, _ = _prompts(spark, sf)
    foreign = T.noisy_prompts(spark, sf)
    model, labels = models.fit(train, "category", "bayes")
    path = f"{shared_folder(spark)}/router-{uuid.uuid4().hex}"
    model.write().save(path)
    return models.score_stored(path, labels, foreign, ["id"], "category")


def _with_family(spark, sf):
    return T.prompt_table(spark, sf).withColumn("family", text.template_family(F.col("subcategory")))


@query(
    "p15_family_folds",
    f"""WITH {Q.PROMPTS}, f AS (SELECT category, CASE WHEN starts_with(category, 'SYMBOLIC') THEN replace(replace(subcategory, 'time_', ''), 'count_', '') END AS family, count(*) AS n FROM prompts GROUP BY ALL)
    SELECT category, family AS held_out, n AS n_test, (SELECT count(*) FROM prompts) - n AS n_train FROM f WHERE starts_with(category, 'SYMBOLIC') AND n >= 5""",
)
def p15(spark, sf):
    return models.family_folds(_with_family(spark, sf), "category", "family", SYMBOLIC)


@query("p15_family_out")
def p15_out(spark, sf):
    rows = checkpoint(_with_family(spark, sf))
    return models.family_out(rows, "id", "category", "family", SYMBOLIC, kind="bayes")


@query("p15_linear_family_out")
def p15_linear(spark, sf):
    rows = checkpoint(_with_family(spark, sf))
    return models.linear_family_out(rows, "id", "category", "family", SYMBOLIC)
