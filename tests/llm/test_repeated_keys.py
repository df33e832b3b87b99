"""Fits take one row of a key, however often it repeats."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from qaloom.llm import language, quality


@pytest.fixture
def docs(spark):
    rows = [(i, f"the number {i} is good and plain", "en") for i in range(60)] + [(i, f"die zahl {i} ist gut und klar", "de") for i in range(60, 120)]
    one = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    key = one.filter(language._fold(F.col("doc_id")) != language.HELD_FOLD).first().doc_id
    copies = [(key, f"the copy {i} of one key", "en") for i in range(200)] + [(key, "ein text unter anderem namen", "de")]
    return one.unionByName(spark.createDataFrame(copies, one.schema))


def counted(monkeypatch, name):
    seen, real = [], getattr(DataFrame, name)

    def count(self, *args, **options):
        out = real(self, *args, **options)
        seen.append(out.num_rows if hasattr(out, "num_rows") else len(out))
        return out

    kind = next(k for k in DataFrame.__subclasses__() if k.__module__.startswith("pyspark.sql.classic"))
    real = getattr(kind, name)
    monkeypatch.setattr(kind, name, count)
    return seen


def test_language_fit_brings_one_row_per_key(docs, monkeypatch):
    seen = counted(monkeypatch, "collect")
    model = language.fit(docs, rows_per_language=30)
    assert max(seen) <= 2 * 30 and model.languages == ("de", "en")
    again = language.fit(docs.repartition(7), rows_per_language=30)
    assert np.array_equal(model.bits, again.bits) and np.allclose(model.weights, again.weights, atol=1e-4)


def test_quality_fit_brings_one_row_per_key(spark, docs, monkeypatch):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    seen = counted(monkeypatch, "toArrow")
    quality.fit(docs, labels, positives=20, unlabelled=50)
    assert max(seen) <= 70
