"""The paths that only large groups take, forced on small data and compared with brute force."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.operators import bootstrap, curation, ranking, similarity
from qaloom.plans import tables


def vectors(spark, n=220, copies=60, seed=3):
    """Two blocks of clustered unit vectors; a third of one block is copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 8))
    rows = []
    for i in range(n):
        v = centres[i % 5] + rng.normal(scale=0.25, size=8)
        if i % 3 == 0 and i < 3 * copies:
            v = centres[0]
        rows.append((i, "ab"[i % 2], [float(x) for x in v / np.linalg.norm(v)]))
    return rows, spark.createDataFrame(rows, "id bigint, block string, v array<double>").repartition(5)


def brute_pairs(rows, t):
    out = []
    for (i, bi, x), (j, bj, y) in itertools.combinations(rows, 2):
        if bi == bj and np.dot(x, y) > t:
            out.append((i, j))
    return out


SIZES = [{"cell_rows": 8192, "chunk_rows": 1024}, {"cell_rows": 10, "chunk_rows": 7}, {"cell_rows": 1000, "chunk_rows": 13}]


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("threshold", [0.9, 0.97])
def test_pairs_and_counts_match_brute_force(spark, sizes, threshold):
    rows, df = vectors(spark)
    expected = brute_pairs(rows, threshold)
    found = similarity.similar_pairs(df, "id", "v", ["block"], threshold, **sizes).collect()
    assert sum(r.n_pairs for r in found) == len(expected)
    assert len({(r.block, r.id_a, r.id_b) for r in found}) == len(found)
    counts = similarity.near_duplicate_counts(df, "id", "v", ["block"], [threshold, 0.995], **sizes)
    by_block = {r.block: r for r in counts.collect()}
    for block in "ab":
        mine = [r for r in rows if r[1] == block]
        row = by_block[block].asDict()
        name = f"above_{threshold:g}".replace(".", "_")
        assert row[name] == len(brute_pairs(mine, threshold))
        assert row["above_0_995"] == len(brute_pairs(mine, 0.995))
        assert row["n_pairs"] == len(mine) * (len(mine) - 1) // 2


def test_largest_cosine_is_found_below_every_threshold(spark):
    rows = [(0, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (2, "b", [1.0, 0.0]), (3, "b", [-1.0, 0.0]), (4, "c", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, block string, v array<double>")
    got = similarity.near_duplicate_counts(df, "id", "v", ["block"], [0.9]).collect()
    assert {r.block: r.max_cosine for r in got} == {"a": 0.0, "b": -1.0, "c": None}


def greedy(rows, t):
    kept = []
    for i, b, x in rows:
        if not any(b == bk and np.dot(x, y) > t for _, bk, y in kept):
            kept.append((i, b, x))
    return {i for i, _, _ in kept}


@pytest.mark.parametrize("sizes", SIZES)
def test_greedy_and_one_shot_match_brute_force(spark, sizes):
    rows, df = vectors(spark)
    t = 0.95
    got = {r.id for r in similarity.dedup_greedy(df, "id", "v", ["block"], t, **sizes).collect()}
    assert got == greedy(rows, t)
    later = {j for _, j in brute_pairs(rows, t)}
    got = {r.id for r in similarity.dedup_one_shot(df, "id", "v", ["block"], t, **sizes).collect()}
    assert got == {i for i, _, _ in rows} - later


def test_chain_keeps_alternate_members(spark):
    step = math.acos(0.96)
    rows = [(i, "a", [math.cos(i * step), math.sin(i * step)]) for i in range(9)]
    df = spark.createDataFrame(rows, "id bigint, block string, v array<double>")
    kept = similarity.dedup_greedy(df, "id", "v", ["block"], 0.95)
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4, 6, 8]
    assert [r.id for r in similarity.dedup_one_shot(df, "id", "v", ["block"], 0.95).collect()] == [0]
    again = similarity.dedup_greedy(kept, "id", "v", ["block"], 0.95)
    assert again.count() == 5
    only = similarity.dedup_greedy(df, "id", "v", ["block"], 0.95, eligible=F.col("id") > 5)
    assert sorted(r.id for r in only.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


def drops_of(edges):
    dropped = set()
    for a, b in sorted(edges, key=lambda e: e[1]):
        if a not in dropped:
            dropped.add(b)
    return dropped


@pytest.mark.parametrize("local_edges", [1_000_000, 40])
def test_first_independent_set_of_random_graphs(spark, local_edges):
    rng = random.Random(6)
    edges = {(g, *sorted(rng.sample(range(80), 2))) for g in ("a", "b", None) for _ in range(200 if g else 30)}
    df = spark.createDataFrame(sorted(edges, key=str), "g string, first bigint, second bigint")
    got = {tuple(r) for r in similarity.first_independent(df, ["g"], local_edges).collect()}
    assert got == {(g, v) for g in ("a", "b", None) for v in drops_of([(a, b) for x, a, b in edges if x == g])}


def test_a_chain_of_ten_thousand_needs_no_rounds(spark):
    df = spark.range(9999).select(F.lit("x").alias("g"), F.col("id").alias("first"), (F.col("id") + 1).alias("second"))
    got = similarity.first_independent(df, ["g"])
    assert sorted(r.id for r in got.collect()) == list(range(1, 10_000, 2))


def test_dense_groups_are_thinned_before_pairs_are_listed(spark, monkeypatch):
    monkeypatch.setattr(similarity, "EDGES_PER_ROW", 2)
    monkeypatch.setattr(similarity, "LOCAL_EDGES", 10)
    step = math.acos(0.96)
    rows = [(i, "a", [math.cos(i * step / 5), math.sin(i * step / 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, block string, v array<double>")
    kept = {r.id for r in similarity.dedup_greedy(df, "id", "v", ["block"], 0.95).collect()}
    edges = [(a, b) for a in range(60) for b in range(a + 1, 60) if math.cos((b - a) * step / 5) > 0.95]
    assert kept == set(range(60)) - drops_of(edges)


def unit_rows(spark, x):
    rows = [(i, "a", (v / np.linalg.norm(v)).tolist(), 1) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, block string, vec array<double>, copies bigint")


def test_vectors_without_structure_are_not_sent_to_every_cell(spark):
    n, chunk = 400, 100
    df = unit_rows(spark, np.random.default_rng(4).normal(size=(n, 16)))
    assert similarity._tiled(df, ["block"], 0.3, 20, chunk).count() <= n * math.ceil(n / chunk)
    centres = np.eye(16)[np.arange(n) % 4] + np.random.default_rng(4).normal(scale=0.01, size=(n, 16))
    tiles = similarity._tiled(unit_rows(spark, centres), ["block"], 0.9, 20, chunk)
    assert tiles.select("cell").distinct().count() > 1
    assert tiles.count() < n * math.ceil(n / chunk)


@pytest.mark.parametrize("first", [4, 25])
def test_a_dense_block_is_settled_by_its_first_rows(spark, monkeypatch, first):
    monkeypatch.setattr(similarity, "FIRST_ROWS", first)
    monkeypatch.setattr(similarity, "EDGES_PER_ROW", 2)
    monkeypatch.setattr(similarity, "LOCAL_EDGES", 100)
    x = np.random.default_rng(9).normal(size=(300, 6))
    rows = [(i, "ab"[i % 2], (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, block string, v array<double>").repartition(5)
    called, flagged = [], similarity._flagged
    monkeypatch.setattr(similarity, "_flagged", lambda *a: called.append(a[0].count()) or flagged(*a))
    got = {r.id for r in similarity.dedup_greedy(df, "id", "v", ["block"], 0.3, cell_rows=40, chunk_rows=30).collect()}
    assert got == greedy(rows, 0.3)
    # No pair of a vector that the first rows settle is counted: never those of all rows.
    assert max(called, default=0) < len(rows)


def skewed(spark, n=3000):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", (i * 37) % 101 / 7.0 if i % 2 else 5.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, g string, v double").repartition(6)


@pytest.mark.parametrize("seed", ["s", None])
def test_pieced_ranks_equal_a_plain_window(spark, seed):
    _, df = skewed(spark)
    plain = ranking.ranked(df, ["g"], "id", seed)
    pieced = ranking.ranked(df, ["g"], "id", seed, rows_per_task=100)
    assert sorted(plain.collect()) == sorted(pieced.select(plain.columns).collect())
    whole = ranking.ranked(df, [], "id", seed, rows_per_task=100)
    assert sorted(r["rank"] for r in whole.collect()) == list(range(3000))


@pytest.mark.parametrize("bits", [1, 5, 12])
def test_percentiles_are_exact(spark, bits):
    rows, df = skewed(spark, 300 if bits == 1 else 3000)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in ranking.percentiles(df, ["g"], "v", shares, bits).collect()}
    for g in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == g]
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.percentile(values, 100 * share), abs=1e-12)
    one = ranking.percentiles(df, [], "v", {"p": 0.3}, bits).first()
    assert one.p == pytest.approx(np.percentile([r[2] for r in rows], 30))


def test_percentiles_over_all_magnitudes_and_groups(spark):
    """Values from the least to the largest double, both signs, both zeros, a null group, null values, one hot value."""
    rng = random.Random(7)
    rows = [(rng.choice(["a", None]), rng.choice([-1, 1]) * 10 ** rng.uniform(-320, 308)) for _ in range(2000)]
    rows += [("b", x) for x in (-0.0, 0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308)]
    rows += [("c", 4.25)] * 3000 + [("c", 1.0), ("c", None), ("d", None), ("e", math.inf), ("e", -math.inf), ("e", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p100": 1.0}
    got = {r.g: r for r in ranking.percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"a", None, "b", "c", "e"}
    for g in ("a", None, "b", "c"):
        values = sorted(v for k, v in rows if k == g and v is not None)
        for name, share in shares.items():
            at = share * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert got[g][name] == (low if low == high else pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12))
    assert (got["e"].p0, got["e"].p50, got["e"].p100) == (-math.inf, 1.0, math.inf)


def test_percentiles_order_no_values(spark):
    """The windows of a hot group run over bucket counts: at most as many rows as a round has buckets."""
    df = spark.range(200_000).select(F.lit("hot").alias("g"), F.sqrt(F.col("id") + 1_000_000).alias("v"))
    rows = df.select("g", ranking._image(F.col("v")).alias("__z"))
    open_ = rows.groupBy("g").agg(F.min("__z").alias("lo"), F.max("__z").alias("hi"), F.lit(0).alias("slot"), F.lit(99_999).alias("rank"))
    narrowed = ranking._narrowed(rows, open_, ["g"], 8).first()
    assert narrowed.lo <= rows.where("__z is not null").select(F.percentile("__z", 0.5)).first()[0] <= narrowed.hi * (1 + 1e-9)
    assert rows.where(F.col("__z").between(narrowed.lo, narrowed.hi)).count() < 200_000 / 50
    assert ranking.percentiles(df, ["g"], "v", {"m": 0.5}).first().m == pytest.approx((math.sqrt(1_099_999) + math.sqrt(1_100_000)) / 2, abs=1e-12)


def test_broadcasts_are_measured(spark, monkeypatch):
    from qaloom import session

    def broadcast(df):
        return "broadcast" in session.lookup(df, 100)._jdf.queryExecution().analyzed().toString().lower()

    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.lit(None).cast("string").alias("n"), F.array("id").alias("a"))
    assert broadcast(wide) and broadcast(wide.limit(0)) and not broadcast(spark.range(101).toDF("id"))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 40_000)
    assert not broadcast(wide) and broadcast(wide.drop("t"))


def test_split_sizes_are_exact(spark):
    rows, df = skewed(spark)
    split = curation.stratified_split(df, "g", "id")
    sizes = {(r.g, r.split): r["count"] for r in split.groupBy("g", "split").count().collect()}
    for g in {r[1] for r in rows}:
        n = sum(r[1] == g for r in rows)
        assert sizes[g, "train"] == int(n * 0.70)
        assert sizes[g, "val"] == int(n * 0.15)
        assert sizes[g, "test"] == n - int(n * 0.70) - int(n * 0.15)
    other = curation.stratified_split(df.repartition(11), "g", "id", rows_per_task=50)
    assert sorted(split.collect()) == sorted(other.collect())


@pytest.mark.parametrize("size", [10, 1000, 1_000_000_000])
def test_bootstrap_agrees_with_theory_at_every_size(spark, size):
    cells = spark.createDataFrame([("x", c, int(size * s)) for c, s in enumerate((0.3, 0.2, 0.5))], "g string, c int, n bigint")
    again = bootstrap.resampled(cells, ["g"], ["c"], 2000)
    rows = again.groupBy("replicate").pivot("c", [0, 1, 2]).agg(F.sum("n")).fillna(0).collect()
    assert len(rows) == 2000
    for c, share in enumerate((0.3, 0.2, 0.5)):
        n = [r[str(c)] for r in rows]
        assert all(x == int(x) >= 0 for x in n)
        spread = math.sqrt(size * share * (1 - share))
        assert sum(n) / 2000 == pytest.approx(size * share, abs=4 * spread / math.sqrt(2000))
        mean = sum(n) / 2000
        assert math.sqrt(sum((x - mean) ** 2 for x in n) / 1999) == pytest.approx(spread, rel=0.08)
    assert all(r["0"] + r["1"] + r["2"] == size for r in rows)
    assert sorted(again.collect()) == sorted(bootstrap.resampled(cells.repartition(3), ["g"], ["c"], 2000).collect())


def test_exact_dedup_keeps_the_first_row(spark):
    random.seed(1)
    rows = [(i, random.choice("abc"), i * 10) for i in range(200)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, t string, x bigint")
    got = sorted(tuple(r) for r in curation.dedup_exact(df, "t", "id").collect())
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1], r)
    assert got == sorted(first.values())
    assert curation.dedup_exact(curation.dedup_exact(df, "t", "id"), "t", "id").count() == 3


def test_tasks_of_prompts_grow_with_their_number(spark, monkeypatch):
    sf = os.environ.get("QALOOM_TEST_SF", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    n = tables.prompt_seeds(spark, sf).count()
    monkeypatch.setattr(tables, "PROMPTS_PER_TASK", math.ceil(n / 20), raising=False)
    # Facts of very many customers are not broadcast.
    monkeypatch.setattr(tables, "lookup", lambda df, **_: df)
    monkeypatch.setattr(tables.prompts, "expand_templates", lambda df, key: df)
    monkeypatch.setattr(tables, "admitted", lambda df: df.select("id", F.lit("x").alias("category"), F.lit("{}").alias("params"), F.lit("p").alias("prompt")))
    monkeypatch.setattr(tables.conv, "symbolic_answer", lambda *a: F.lit("yes"))
    for made in (tables.prompt_table, tables.pairs):
        sizes = made(spark, sf).groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count")).first()
        assert sizes[0] > 10
        assert sizes[1] < 3 * math.ceil(n / 20)
