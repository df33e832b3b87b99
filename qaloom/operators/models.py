"""Router classifiers on Spark ML: fitting, calibration, ensembles, benchmarks, cross-validation.

Only the list of models is walked on the driver; every fit and every score is a Spark job. All
predictions end in one long table (id, truth, prediction, probabilities) for the metrics.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StringIndexerModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions import draws, rules
from qaloom.functions.text import mask_digits
from qaloom.operators import calibration, linear, metrics, perceptron
from qaloom.operators.features import TERM, class_weights, embedding_vector, frequent_terms, ngrams, top_terms, weighed, words
from qaloom.session import checkpoint

PIECES = 100_000  # rows that copies are dealt to, beyond one for each distinct text


def text_stages(text: str = "prompt", largest: int = 2, mask: bool = True) -> list:
    """M1/M2: digit masking, words and n-grams as the column ``__terms``.

    Masking is a stage, so text scored later is masked exactly as the training text was.
    """
    source = f"regexp_replace({text}, '[0-9]+', '<NUM>')" if mask else text
    masked = SQLTransformer(statement=f"SELECT *, {source} AS __text FROM __THIS__")
    words = RegexTokenizer(
        inputCol="__text", outputCol="__words", pattern=TERM, gaps=False, toLowercase=True
    )
    parts, grams = ["__words"], []
    for n in range(2, largest + 1):
        grams.append(NGram(n=n, inputCol="__words", outputCol=f"__grams{n}"))
        parts.append(f"__grams{n}")
    joined = f"SELECT *, concat({', '.join(parts)}) AS __terms FROM __THIS__"
    return [masked, words, *grams, SQLTransformer(statement=joined)]


def term_stages(terms: list[tuple[str, int, int]], n: int) -> list:
    """M1/M2: counts over a vocabulary (term, total, df) of ``n`` texts, Spark's IDF ln((n + 1) / (df + 1)), and unit length."""
    idf = [math.log((n + 1) / (df + 1)) for _, _, df in terms]
    return [
        CountVectorizerModel.from_vocabulary([t for t, _, _ in terms], inputCol="__terms", outputCol="__tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__tfidf"),
        Normalizer(inputCol="__tfidf", outputCol="features", p=2.0),
    ]


def collapsed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of ``columns`` with their number of rows, ``copies``; counted where the rows are read."""
    n = F.sum("copies") if "copies" in df.columns else F.count(F.lit(1))
    return df.groupBy(*columns).agg(n.alias("copies"))


def collapsed_texts(df: DataFrame, text: str, columns: list[str], mask: bool = True) -> DataFrame:
    """The distinct (masked) texts and ``columns``, with ``copies``. Masking them again changes nothing."""
    return collapsed(df.withColumn(text, mask_digits(F.col(text))) if mask else df, [text, *columns])


def scores_of(found: DataFrame, truth: str, by: list[str] | None = None) -> DataFrame:
    """``metrics.class_scores`` of predictions that count ``copies`` times."""
    counts = found.groupBy(*(by or []), truth, "prediction").agg(F.sum("copies").cast("double").alias("n"))
    return metrics.class_scores_from(counts, truth, "prediction", "n", by or [])


def with_terms(df: DataFrame, text: str = "prompt", largest: int = 2, mask: bool = True) -> DataFrame:
    """Adds the ready terms of a text, for callers that fit many models on the same rows."""
    source = mask_digits(F.col(text)) if mask else F.col(text)
    return df.withColumn("__terms", ngrams(source, largest))


def classifier(kind: str, n_features: int = 0, n_classes: int = 0, regularisation: float = 1e-3, trees: int = 20, parallel: int = 1):
    """M4-M8: an unfitted classifier by name, class-weighted where the algorithm allows it."""
    shared = {"featuresCol": "features", "labelCol": "label"}
    if kind == "logistic":
        return LogisticRegression(
            **shared, weightCol="weight", maxIter=1000, tol=1e-4, regParam=regularisation, family="multinomial"
        )
    if kind == "svm":
        base = LinearSVC(featuresCol="features", weightCol="weight", maxIter=30, regParam=regularisation)
        return OneVsRest(classifier=base, labelCol="label", weightCol="weight")
    if kind == "bayes":
        return NaiveBayes(**shared, weightCol="weight", smoothing=1.0, modelType="multinomial")
    if kind == "boosted":
        base = GBTClassifier(featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=5, seed=42)
        return OneVsRest(classifier=base, labelCol="label", weightCol="weight", parallelism=parallel)
    if kind == "forest":
        return RandomForestClassifier(**shared, weightCol="weight", numTrees=50, seed=42)
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(
            **shared, layers=[n_features, 256, 64, n_classes], maxIter=50, seed=42
        )
    raise ValueError(f"unknown classifier {kind!r}")


def prepared(df: DataFrame, label: str, labels: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The input with a numeric ``label`` and a balanced ``weight``, and the class order."""
    if labels is None:
        labels = sorted(r[0] for r in df.select(label).distinct().collect())
    indexer = StringIndexerModel.from_labels(labels, inputCol=label, outputCol="label", handleInvalid="skip")
    return class_weights(indexer.transform(df), label), labels


def _fitted(kind: str, ready: DataFrame, options: dict):
    """A classifier fitted on prepared rows, which are kept for those that pass over them many times; Spark's logistic model keeps its own blocks."""
    if kind in ("logistic", "bayes"):
        return classifier(kind, **options).fit(ready)
    ready = ready.persist()
    model = classifier(kind, **options).fit(ready)
    ready.unpersist()
    return model


def _fit_terms(df: DataFrame, label: str, kind: str, features: str, text: str, max_terms: int, largest: int, mask: bool, distinct: bool, options: dict):
    """``fit`` on terms: equal texts of a class are one row that counts as often as they occur."""
    labels = _classes(df, label)
    df = df.where(F.col(label).isNotNull())
    if features == "text":
        rows = df if distinct else checkpoint(collapsed_texts(df, text, [label], mask))
        cut = Pipeline(stages=text_stages(text, largest, mask)).fit(rows).stages
        terms = top_terms(rows.withColumn("__text", mask_digits(F.col(text)) if mask else F.col(text)), "__text", max_terms, largest, "copies")
    else:
        rows, cut = checkpoint(collapsed(df, ["__terms", label])), []
        terms = frequent_terms(rows.select(F.col("__terms").alias("__words"), "copies"), max_terms, pairs=False)
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.sum("copies").alias("n")).collect()}
    n = sum(sizes.values())
    stages = [*cut, *term_stages(terms, n)]
    # Spark scales features by a spread that depends on the number of rows a little, so few rows do not stand for very many.
    most = 1 if kind in ("boosted", "forest", "perceptron") else max(1, n // PIECES)
    pieces = F.ceil(F.col("copies") / F.lit(float(most))).cast("int")
    if kind != "bayes":
        rows = rows.withColumn("__pieces", pieces).select("*", F.explode(F.sequence(F.lit(1), F.col("__pieces"))))
        rows = rows.withColumn("copies", F.col("copies") / F.col("__pieces"))
    balanced = F.lit(1.0)
    if kind != "bayes":
        balanced = F.coalesce(*[F.when(F.col(label) == c, n / (len(sizes) * m)) for c, m in sizes.items()])
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)).cast("double") - 1
    rows = rows.withColumns({"label": number, "weight": balanced * F.col("copies")})
    ready = PipelineModel(stages=stages).transform(rows).select("features", "label", "weight")
    return PipelineModel(stages=[*stages, _fitted(kind, ready, options)]), labels


def fit(df: DataFrame, label: str, kind: str, features: str = "text", text: str = "prompt", **options):
    """A fitted pipeline and its class order. ``features``: "text", "terms" or "embedding"; ``distinct``: equal texts are one row with ``copies`` already."""
    max_terms, largest, mask, distinct = (
        options.pop(name, default) for name, default in [("max_terms", 10_000), ("largest", 2), ("mask", True), ("distinct", False)]
    )
    if kind == "perceptron":
        if features == "embedding":
            options["n_features"] = len(df.select(text).first()[0])
        options["n_classes"] = len(_classes(df, label))
    if features != "embedding":
        return _fit_terms(df, label, kind, features, text, max_terms, largest, mask, distinct, options)
    rows, labels = prepared(df, label)
    if "copies" in df.columns:
        rows, sizes = rows.drop("weight"), df.where(F.col(label).isNotNull()).groupBy(label).agg(F.sum("copies").alias("n")).collect()
        total = sum(r["n"] for r in sizes)
        balanced = F.coalesce(*[F.when(F.col(label) == r[label], total / (len(sizes) * r["n"])) for r in sizes])
        rows = rows.withColumn("weight", balanced * F.col("copies"))
    elif kind == "bayes":
        rows = rows.withColumn("weight", F.lit(1.0))
    ready = rows.withColumn("features", embedding_vector(text)).select("features", "label", "weight")
    return PipelineModel(stages=[_fitted(kind, ready, options)]), labels


def predict(model: PipelineModel, labels: list[str], df: DataFrame, keep: list[str], features: str = "text", text: str = "prompt") -> DataFrame:
    """(keep..., prediction, confidence, probabilities); without probabilities the last two are null."""
    rows = df.withColumn("features", embedding_vector(text)) if features == "embedding" else df
    scored = model.transform(rows)
    names = F.array(*[F.lit(x) for x in labels])
    out = [*keep, F.get(names, F.col("prediction").cast("int")).alias("prediction")]
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        out += [F.array_max(p).alias("confidence"), p.alias("probabilities")]
    else:
        out += [
            F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("array<double>").alias("probabilities"),
        ]
    return scored.select(*out)


def fit_platt(
    scored: DataFrame, truth: str, labels: list[str], rounds: int = 60, tolerance: float = 1e-12
) -> list[tuple[float, float]]:
    """M9: (slope, intercept) per class of a sigmoid of the class's probability.

    Newton's method with Platt's smoothed targets, all classes together: one aggregate of a few
    sums per round, so the data is passed over a handful of times whatever the number of classes.
    A class is done, and keeps its values, once a full step promises no gain above ``tolerance`` a row: the
    losses themselves differ by rounding there, so that comparing them would never end. A row counts ``copies`` times, if there are any.
    """
    rows = checkpoint(scored.select(truth, "probabilities", (F.col("copies") if "copies" in scored.columns else F.lit(1)).alias("copies")))
    k = range(len(labels))
    counts = rows.agg(F.sum("copies"), *[F.sum(F.when(F.col(truth) == c, F.col("copies"))) for c in labels]).first()
    n, *positive = (x or 0 for x in counts)
    high = [(positive[i] + 1.0) / (positive[i] + 2.0) for i in k]
    low = [1.0 / (n - positive[i] + 2.0) for i in k]

    def sums(params: dict[int, tuple[float, float]]) -> dict[int, tuple[float, ...]]:
        facts = []
        for i, (slope, start) in params.items():
            x = F.get("probabilities", F.lit(i))
            z = F.lit(slope) * x + F.lit(start)
            p = 1.0 / (1.0 + F.exp(-z))
            t = F.when(F.col(truth) == labels[i], high[i]).otherwise(low[i])
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
            w = p * (1.0 - p)
            facts += [F.sum(c * F.col("copies")) for c in (loss, (p - t) * x, p - t, w * x * x, w * x, w)]
        row = rows.agg(*facts).first()
        return {i: tuple(row[6 * j : 6 * j + 6]) for j, i in enumerate(params)}

    params = [(0.0, math.log((positive[i] + 1.0) / (n - positive[i] + 1.0))) for i in k]
    if not n:
        return params
    state, share = sums(dict(enumerate(params))), [1.0 for _ in k]
    for _ in range(rounds):
        tried = {}
        for i in k:
            _, g1, g0, h11, h10, h00 = state[i]
            h11, h00 = h11 + 1e-12, h00 + 1e-12
            det = h11 * h00 - h10 * h10
            step = (h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det
            if (g1 * step[0] + g0 * step[1]) / 2 > tolerance * n:
                tried[i] = params[i][0] - share[i] * step[0], params[i][1] - share[i] * step[1]
        if not tried:
            return params
        for i, found in sums(tried).items():
            if found[0] <= state[i][0]:
                params[i], state[i], share[i] = tried[i], found, 1.0
            else:
                share[i] /= 2.0
    raise ValueError(f"the sigmoid fit did not converge in {rounds} rounds")


def apply_platt(scored: DataFrame, fits: list[tuple[float, float]], labels: list[str]) -> DataFrame:
    """M9: calibrated and renormalised probabilities, with prediction and confidence redone."""
    raw = F.array(
        *[
            1.0 / (1.0 + F.exp(-(F.lit(a) * F.get("probabilities", F.lit(i)) + F.lit(b))))
            for i, (a, b) in enumerate(fits)
        ]
    )
    total = F.aggregate("__raw", F.lit(0.0), lambda s, x: s + x)
    return (
        scored.withColumn("__raw", raw)
        .withColumn("__total", total)
        .withColumn("probabilities", F.transform("__raw", lambda x: x / F.col("__total")))
        .withColumn("prediction", calibration.top_class(F.col("probabilities"), labels))
        .withColumn("confidence", F.array_max("probabilities"))
        .drop("__raw", "__total")
    )


def fold_of(key: str, folds: int = 3) -> Column:
    """The fold of a row."""
    return (draws.draw("fold", F.col(key)) % folds).cast("int")


def word_hashes(df: DataFrame, text: str, size: int = 64) -> DataFrame:
    """Adds ``embedding``: counts of the words between spaces, hashed to ``size`` numbers."""
    hashed = HashingTF(inputCol="__words", outputCol="__hashed", numFeatures=size).transform(df.withColumn("__words", F.split(F.lower(text), r"\s+")))
    return hashed.withColumn("embedding", vector_to_array("__hashed")).drop("__words", "__hashed")


def calibrated_by_folds(
    train: DataFrame, other: DataFrame, key: str, label: str, keep: list[str], folds: int = 3, features: str = "text", text: str = "prompt"
) -> tuple[DataFrame, list[str]]:
    """M10, one side: mean over folds of a logistic fit calibrated on the fold it did not see.

    What is stored of texts is their words, once: equal ones of a class are one row with its number of copies in each fold. Terms are cut
    from them where they are read. Rows of vectors with a ``__fold`` (of ``fold_of``) and ``copies`` need no key.
    """
    rows, options = train if "__fold" in train.columns else train.withColumn("__fold", fold_of(key, folds)), {}
    if features == "text":
        alone = F.array_join(words(mask_digits(F.col(text))), " ")
        counts = [F.count_if(F.col("__fold") == i).alias(f"__n{i}") for i in range(folds)]
        rows = checkpoint(rows.select("__fold", label, alone.alias(text)).groupBy(text, label).agg(*counts))
        other = checkpoint(other.select(*keep, alone.alias(text)))
        options = {"distinct": True}
    parts, labels = None, None
    for i in range(folds):
        if features == "text":
            n = [F.col(f"__n{j}") for j in range(folds)]
            fitted = rows.withColumn("copies", sum((n[j] for j in range(folds) if j != i), F.lit(0))).where("copies > 0")
            unseen = rows.withColumn("copies", n[i]).where("copies > 0")
        else:
            fitted, unseen = rows.where(F.col("__fold") != i), rows.where(F.col("__fold") == i)
            unseen = unseen if "copies" in rows.columns else unseen.withColumn("copies", F.lit(1))
        model, names = fit(fitted, label, "logistic", features, text, **options)
        labels = labels or names
        platt = fit_platt(predict(model, names, unseen, [label, "copies"], features, text), label, names)
        part = apply_platt(predict(model, names, other, keep, features, text), platt, names)
        part = part.select(*keep, "probabilities")
        parts = part if parts is None else parts.unionByName(part)
    n = len(labels)
    means = F.array(*[F.avg(F.get("probabilities", F.lit(i))) for i in range(n)])
    return parts.groupBy(*keep).agg(means.alias("probabilities")), labels


def ensemble(first: DataFrame, second: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Average of two probability arrays per row, arg-max as prediction."""
    other = second.select(*keys, F.col("probabilities").alias("__p2"))
    both = first.join(other, keys)
    mean = F.zip_with("probabilities", "__p2", lambda a, b: (a + b) / 2)
    return (
        both.withColumn("probabilities", mean)
        .drop("__p2")
        .withColumn("prediction", calibration.top_class(F.col("probabilities"), labels))
        .withColumn("confidence", F.array_max("probabilities"))
    )


def benchmark(train: DataFrame, sets: dict[str, DataFrame], key: str, label: str, models: dict[str, dict]) -> DataFrame:
    """Overall scores per (set, model). A model spec: kind, features, text, rows, options.

    ``rows`` may restrict the training rows (clean-only, noisy-only). Equal texts of a class are scored once. All predictions go to
    one long table and are scored by one aggregate. Besides those of ``fit`` there are the kinds "keyword" (the rules, not fitted), and "svm" on
    texts, "perceptron" and "ensemble" by the fits of ``linear``, ``perceptron`` and ``calibrated_by_folds``. Embeddings are ``word_hashes`` of masked texts.
    """
    long, distinct = None, {}

    def asked(set_name: str, column: str, embedded: bool) -> DataFrame:
        if (set_name, column, embedded) not in distinct:
            df = sets[set_name]
            rows = word_hashes(collapsed_texts(df, column, [label]), column) if embedded else collapsed(df, [column, label])
            distinct[set_name, column, embedded] = checkpoint(rows)
        return distinct[set_name, column, embedded]

    for name, spec in models.items():
        spec = dict(spec)
        kind, features = spec.pop("kind"), spec.pop("features", "text")
        column, rows = spec.pop("text", "prompt"), spec.pop("rows", None)
        part, embedded = train if rows is None else train.where(rows), features == "embedding" or kind == "ensemble"
        questions = {s: asked(s, column, embedded) for s in sets}
        for set_name, found in _answers(kind, features, column, part, questions, key, label, spec).items():
            found = found.select(F.lit(set_name).alias("set"), F.lit(name).alias("model"), label, "copies", "prediction")
            long = found if long is None else long.unionByName(found)
    return metrics.overall_scores(scores_of(long, label, ["set", "model"]), ["set", "model"])


def _answers(kind: str, features: str, text: str, train: DataFrame, sets: dict[str, DataFrame], key: str, label: str, spec: dict) -> dict[str, DataFrame]:
    """(label, copies, prediction) of each set by one model of ``benchmark``."""
    keep = [label, "copies"]
    if kind == "keyword":
        return {s: df.select(*keep, rules.keyword_route(F.col(text)).alias("prediction")) for s, df in sets.items()}
    if kind == "svm" and features == "text":
        rows = checkpoint(collapsed_texts(train, text, [label], spec.get("mask", True))).withColumn("set", F.lit(None).cast("string"))
        every = rows
        for s, df in sets.items():
            every = every.unionByName(df.select(text, label, "copies", F.lit(s).alias("set")))
        ready, n, labels = text_rows(rows, every, label, text, **spec)
        fits = linear.fit_all(ready.where("set IS NULL"), n, len(labels), {"svm": linear.Fit("svm")})
        # Rows of classes that were not fitted have no number, and count as wrong.
        left = {s: df.where(~F.coalesce(F.col(label).isin(labels), F.lit(False))).select(*keep, F.lit(None).cast("string").alias("prediction")) for s, df in sets.items()}
        return {s: linear_predictions(ready.where(F.col("set") == s), fits, labels, keep).select(*keep, "prediction").unionByName(left[s]) for s in sets}
    if features != "embedding" and kind != "ensemble":
        model, labels = fit(train, label, kind, features, text, **spec)
        return {s: predict(model, labels, df, keep, features, text) for s, df in sets.items()}
    train = train.where(F.col(label).isNotNull()).withColumn(text, mask_digits(F.col(text)))
    if kind == "ensemble":
        folded = word_hashes(collapsed(train.withColumn("__fold", fold_of(key)), [text, label, "__fold"]), text)
        every = None
        for s, df in sets.items():
            df = df.withColumns({"set": F.lit(s), "asked": F.col(text)})
            every = df if every is None else every.unionByName(df)
        ids = ["set", "asked", *keep]
        first, labels = calibrated_by_folds(train, every, key, label, ids)
        second, _ = calibrated_by_folds(checkpoint(folded.drop(text)), every, key, label, ids, features="embedding", text="embedding")
        found = checkpoint(ensemble(first, second, ids, labels).select("set", *keep, "prediction"))
        return {s: found.where(F.col("set") == s) for s in sets}
    if kind == "perceptron":
        # A share of the rows, not of the texts, is held out.
        held = draws.unit("held", F.col(key)) < 0.15
        rows = train.groupBy(text, label).agg(F.count_if(~held).alias("copies"), F.count_if(held).alias("held"))
        labels = _classes(train, label)
        unit = {s: _unit_length(df) for s, df in sets.items()}
        ready = checkpoint(_numbered(_unit_length(word_hashes(rows, text)), label, labels))
        layers = perceptron.fit(ready, ready.select(F.size("embedding")).first()[0], len(labels), **spec)
        return {s: perceptron.predict(df, layers, labels, keep) for s, df in unit.items()}
    rows = checkpoint(word_hashes(collapsed(train, [text, label]), text))
    model, labels = fit(rows, label, kind, "embedding", "embedding", **spec)
    return {s: predict(model, labels, df, keep, "embedding", "embedding") for s, df in sets.items()}


def _unit_length(df: DataFrame) -> DataFrame:
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return df.withColumn("embedding", F.transform("embedding", lambda x: F.when(length > 0, x / length).otherwise(0.0)))


def cross_validated(df: DataFrame, key: str, label: str, grid: dict[str, dict], folds: int = 5, features: str = "text", text: str = "prompt") -> DataFrame:
    """Macro-F1 mean and spread over folds per grid entry; folds by hash draw.

    Spark's own evaluator has weighted F1 only, so the out-of-fold predictions are kept and scored.
    Texts are cut into terms once per shape, not once per fit.
    """
    fold = (draws.draw("cv", F.col(key)) % folds).cast("int")
    base, long, ready = df.withColumn("__fold", fold), None, {}
    for name, spec in grid.items():
        spec = dict(spec)
        kind = spec.pop("kind")
        shape = (spec.get("largest", 2), spec.get("mask", True)) if features == "text" else None
        if shape not in ready:
            ready[shape] = checkpoint(with_terms(base, text, *shape) if shape else base)
        rows, using = ready[shape], "terms" if shape else features
        for i in range(folds):
            model, labels = fit(rows.where(F.col("__fold") != i), label, kind, using, text, **spec)
            part = predict(model, labels, rows.where(F.col("__fold") == i), [key, label], using, text)
            part = part.select(F.lit(name).alias("model"), F.lit(i).alias("fold"), key, label, "prediction")
            long = part if long is None else long.unionByName(part)
    scores = metrics.class_scores(long, label, "prediction", ["model", "fold"])
    per_fold = metrics.overall_scores(scores, ["model", "fold"])
    return per_fold.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("macro_f1").alias("mean_macro_f1"),
        F.stddev_pop("macro_f1").alias("std_macro_f1"),
    )


def text_rows(
    train: DataFrame, rows: DataFrame, label: str, text: str = "prompt", max_terms: int = 10_000, largest: int = 2, mask: bool = True
) -> tuple[DataFrame, int, list[str]]:
    """``rows`` with TF-IDF features for ``linear`` (indices, values, label number), the number of features, and the classes.

    The vocabulary, its weights and the classes are those of ``train``; rows of other classes are left out. A row counts
    ``copies`` times, if ``train`` has that column.
    """
    def masked(df: DataFrame) -> DataFrame:
        return df.withColumn("__text", mask_digits(F.col(text)) if mask else F.col(text))

    labels = _classes(train, label)
    keep = [c for c in rows.columns if c not in (text, "indices", "values", "label", "__text")]
    copies = "copies" if "copies" in train.columns else None
    found, n = weighed(masked(train), masked(rows), keep, "__text", max_terms, largest, copies=copies)
    return _numbered(found, label, labels), n, labels


def vector_rows(train: DataFrame, rows: DataFrame, label: str, vector: str = "embedding") -> tuple[DataFrame, int, list[str]]:
    """The same from an embedding column, scaled to unit length."""
    n = train.select(F.size(vector)).first()[0]
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    values = F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(0.0))
    labels = _classes(train, label)
    found = rows.withColumns({"indices": F.sequence(F.lit(0), F.lit(n - 1)), "values": values})
    return _numbered(found, label, labels), n, labels


def _classes(df: DataFrame, label: str) -> list[str]:
    return sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())


def _numbered(rows: DataFrame, label: str, labels: list[str]) -> DataFrame:
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)).cast("int") - 1
    return rows.where(F.col(label).isin(labels)).withColumn("label", number)


def linear_predictions(
    rows: DataFrame, models: dict[str, linear.Linear], labels: list[str], keep: list[str], subset: dict[str, str] | None = None
) -> DataFrame:
    """(model, keep..., prediction, scores) of linear models."""
    found = linear.predict_all(rows, models, keep, subset)
    return found.withColumn("prediction", F.get(F.array(*[F.lit(x) for x in labels]), F.col("class"))).drop("class")


def cv_fold(key: str, folds: int = 5) -> Column:
    """The fold of a row of a grid."""
    return (draws.draw("cv", F.col(key)) % folds).cast("int")


def linear_grid(
    rows: DataFrame, n: int, labels: list[str], key: str, label: str, grid: dict[str, tuple[str, float]],
    folds: int = 5, train: str = "train", test: str | None = "test", balanced: bool = True,
) -> DataFrame:
    """Every (loss, C) of the grid in ``folds`` folds of the rows marked ``train``, and once on all of them for those marked ``test``.

    All fits are taken together, so a step of the whole grid is one pass over the rows. One row per grid entry: mean and spread
    of macro-F1 over the folds, macro-F1 and accuracy on the test rows, and whether the entry is the best of its loss. Without
    ``test`` there are the folds alone, and ``converged`` is of all of them. Rows with a ``fold`` (of ``cv_fold``) need no key, and
    count ``copies`` times.
    """
    rows = linear.with_folds(rows, F.col("fold") if "fold" in rows.columns else cv_fold(key, folds), folds)
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    for i in range(folds):
        rows = rows.withColumns({f"in{i}": F.col(train) & F.col(f"in{i}"), f"out{i}": F.col(train) & F.col(f"out{i}")})
    rows = checkpoint(rows)
    fits, scored = {}, {}
    for name, (loss, c) in grid.items():
        for i in range(folds):
            fits[f"{name}#{i}"], scored[f"{name}#{i}"] = linear.Fit(loss, c, f"in{i}", balanced), f"out{i}"
        if test:
            fits[f"{name}#test"], scored[f"{name}#test"] = linear.Fit(loss, c, train, balanced), test
    models = linear.fit_all(rows, n, len(labels), fits)
    found = linear_predictions(rows, models, labels, [label, "copies"], scored)
    parts = F.split("model", "#")
    found = found.select(F.get(parts, F.lit(0)).alias("model"), F.get(parts, F.lit(1)).alias("fold"), label, "copies", "prediction")
    scores = metrics.overall_scores(scores_of(found, label, ["model", "fold"]), ["model", "fold"])
    cv, whole = F.col("fold") != "test", F.col("fold") == "test"
    out = scores.groupBy("model").agg(
        F.count_if(cv).alias("n_folds"),
        F.avg(F.when(cv, F.col("macro_f1"))).alias("mean_macro_f1"),
        F.stddev_pop(F.when(cv, F.col("macro_f1"))).alias("std_macro_f1"),
        F.max(F.when(whole, F.col("macro_f1"))).alias("test_macro_f1"),
        F.max(F.when(whole, F.col("accuracy"))).alias("test_accuracy"),
    )
    ended = {name: all(m.converged for n, m in models.items() if n == f"{name}#test" or not test and n.startswith(f"{name}#")) for name in grid}
    told = out.sparkSession.createDataFrame(
        [(name, loss, float(c), ended[name]) for name, (loss, c) in grid.items()],
        "model string, loss string, c double, converged boolean",
    )
    out = out.join(F.broadcast(told), "model")
    best = Window.partitionBy("loss").orderBy(F.desc("mean_macro_f1"), "c")  # a row per grid entry
    return out.withColumn("best", F.row_number().over(best) == 1)


def linear_family_out(
    df: DataFrame, key: str, category: str, family: str, symbolic: list[str], losses: tuple[str, ...] = ("logistic", "svm"), text: str = "prompt", min_test: int = 5
) -> DataFrame:
    """Accuracy on each held-out family of linear models trained on everything else; the fits of all folds are taken together."""
    folds = [(r[0], r["held_out"]) for r in family_folds(df, category, family, symbolic, min_test).select(category, "held_out").collect()]
    if not folds:
        raise ValueError("no category has two families of sufficient size")
    df = checkpoint(collapsed_texts(df, text, [category, family]))
    rows, n, labels = text_rows(df, df.withColumn("__family", F.col(family)), category, text)
    held = [(F.col(category) == c) & F.coalesce(F.col("__family") == f, F.lit(False)) for c, f in folds]
    rows = checkpoint(rows.withColumns({f"in{i}": ~h for i, h in enumerate(held)} | {f"out{i}": h for i, h in enumerate(held)}))
    fits = {f"{loss}#{i}": linear.Fit(loss, 1.0, f"in{i}") for i in range(len(folds)) for loss in losses}
    models = linear.fit_all(rows, n, len(labels), fits)
    found = linear_predictions(rows, models, labels, [category, "__family", "copies"], {name: f"out{name.split('#')[1]}" for name in fits})
    out = found.groupBy(category, F.col("__family").alias("held_out"), F.get(F.split("model", "#"), F.lit(0)).alias("model"))
    right = F.sum(F.when(F.col(category) == F.col("prediction"), F.col("copies")).otherwise(0))
    return out.agg(F.sum("copies").alias("n_test"), (right / F.sum("copies")).alias("accuracy"))


def family_folds(df: DataFrame, category: str, family: str, symbolic: list[str], min_test: int = 5) -> DataFrame:
    """The leave-one-family-out folds with their sizes; rows are counted, never repeated."""
    counts = df.groupBy(category, family).agg(F.count(F.lit(1)).alias("n"))
    marked = counts.withColumn("__s", F.col(category).isin(symbolic))
    total = marked.agg(F.sum("n").alias("n_all")).withColumn("__one", F.lit(0))
    sizes = marked.where("__s").groupBy(category).agg(F.count(F.lit(1)).alias("n_families"))
    out = marked.where("__s").join(sizes, category).withColumn("__one", F.lit(0)).join(total, "__one")
    return out.where((F.col("n_families") >= 2) & (F.col("n") >= min_test)).select(
        category, F.col(family).alias("held_out"), F.col("n").alias("n_test"), (F.col("n_all") - F.col("n")).alias("n_train")
    )


def family_out(df: DataFrame, key: str, category: str, family: str, symbolic: list[str], kind: str = "logistic", text: str = "prompt", min_test: int = 5) -> DataFrame:
    """Accuracy on each held-out family of a model trained on everything else."""
    folds = family_folds(df, category, family, symbolic, min_test)
    df, out = checkpoint(with_terms(checkpoint(collapsed_texts(df, text, [category, family])), text)), None
    for row in folds.select(category, "held_out").collect():
        held = (F.col(category) == row[0]) & (F.col(family) == row[1])
        model, labels = fit(df.where(~held), category, kind, "terms", text)
        part = predict(model, labels, df.where(held), [category, "copies"], "terms", text)
        right = F.when(F.col(category) == F.col("prediction"), F.col("copies")).otherwise(0)
        part = part.select(F.lit(row[1]).alias("held_out"), category, "copies", right.alias("right"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no category has two families of sufficient size")
    right = F.sum("right") / F.sum("copies")
    return out.groupBy(category, "held_out").agg(F.sum("copies").alias("n_test"), right.alias("accuracy"))


def score_stored(path: str, labels: list[str], df: DataFrame, keep: list[str], label: str, text: str = "prompt") -> DataFrame:
    """Score prompts with a stored pipeline, equal ones once; accuracy and mean confidence per true category."""
    scored = predict(PipelineModel.load(path), labels, collapsed(df, [text, label]), [label, "copies"], "text", text)
    n = F.sum("copies")
    right = F.sum(F.when(F.col(label) == F.col("prediction"), F.col("copies")).otherwise(0))
    return scored.groupBy(label).agg(
        n.alias("n"),
        (right / n).alias("accuracy"),
        (F.sum(F.col("confidence") * F.col("copies")) / n).alias("mean_confidence"),
    )
