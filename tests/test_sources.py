"""Readers and writers round trip."""

from pyspark.sql import functions as F

from qaloom import schemas
from qaloom.sources import readers, writers


def test_csv_round_trip_with_hard_text(spark, tmp_path):
    rows = [('say "hi", ok', "SEMANTIC", "a"), ("two\nlines; here", "HYBRID", "b"), ("été", "HYBRID", None)]
    df = spark.createDataFrame(rows, schemas.HOLDOUT)
    writers.write_csv(df, str(tmp_path / "t"))
    back = readers.read_csv(spark, str(tmp_path / "t"), schemas.HOLDOUT)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_separator_is_found(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id;label\n1;yes\n2;no, thanks\n")
    back = readers.read_csv_any(spark, str(tmp_path / "s.csv"), "id BIGINT, label STRING")
    assert [tuple(r) for r in back.orderBy("id").collect()] == [(1, "yes"), (2, "no, thanks")]


def test_documents_answers_and_snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k1": {"answer": "yes", "tokens": 3}, "k2": {"answer": "no", "latency_ms": 1.5}}')
    got = {r.cache_key: (r.answer, r.tokens, r.latency_ms) for r in readers.read_answers(spark, str(tmp_path / "a.json")).collect()}
    assert got == {"k1": ("yes", 3, None), "k2": ("no", None, 1.5)}
    for day in ["20240101", "20240302"]:
        writers.write_snapshot(spark.range(3).withColumn("day", F.lit(day)), str(tmp_path / "snap"), day)
    assert {r.day for r in readers.read_latest(spark, str(tmp_path / "snap")).collect()} == {"20240302"}
    writers.write_document(spark.range(1).selectExpr("1 as n", "null as gone"), str(tmp_path / "doc"))
    assert readers.read_document(spark, str(tmp_path / "doc"), "n INT, gone STRING").first().asDict() == {"n": 1, "gone": None}


def test_fingerprint_ignores_order_but_counts_repeats(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "t string")
    b = spark.createDataFrame([("y",), ("x",), ("y",)], "t string").repartition(3)
    c = spark.createDataFrame([("x",), ("y",)], "t string")
    marks = [readers.fingerprint(df, "t").first()[0] for df in (a, b, c)]
    assert marks[0] == marks[1] != marks[2] and len(marks[0]) == 8
