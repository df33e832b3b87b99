"""Operators on pairs, shards and vectors, and the pipeline, against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from qaloom.llm import nearest, queries, resharding, simhash
from qaloom.llm.components import components
from qaloom.session import shared_folder

SF = "/root/testdata/sf0.001"


# ---- near duplicates ----------------------------------------------------------------------------


def plain_fingerprint(text):
    w = simhash.spaced_words((text or "").encode())
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, linked):
    parent = list(range(len(keys)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(keys))]


def test_components_of_fingerprints(spark, edge_docs, no_docs):
    rows = edge_docs.filter("doc_id <> 6 or doc_id is null").collect()
    fp = [plain_fingerprint(r.text) for r in rows]
    roots = plain_components(fp, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    expected = Counter((r.doc_id, f"{f:016x}", least.get(root)) for r, f, root in zip(rows, fp, roots, strict=True))
    got = simhash.digest(simhash.classes(edge_docs.filter("doc_id <> 6 or doc_id is null"))).collect()
    assert Counter(map(tuple, got)) == expected
    assert simhash.classes(no_docs).count() == 0
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns and None in {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("leaf", [2, 16, 4096])
def test_trie_join_loses_no_link_at_any_depth(spark, leaf):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    keys = set(base) | {0, (1 << 64) - 1, 1, 7, 15, 1 << 63}
    for k in base:
        for _ in range(4):
            for _ in range(rng.integers(1, 4)):
                k ^= 1 << int(rng.integers(0, 64))
            keys.add(k)
    dense = base[0]
    keys |= {dense ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a % 7)}
    keys = sorted(keys)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    table = spark.createDataFrame([(k,) for k in signed], "fp bigint")
    found = {r.node: r.root for r in components(simhash.links(table, leaf)).collect()}
    assert len(found) == components(simhash.links(table, leaf)).count()
    names = [found.get(k, k) for k in signed]
    expected = plain_components(keys, lambda a, b: (a ^ b).bit_count() <= 3)
    pairs = {(a, b) for a, b in zip(names, expected, strict=True)}
    assert len(pairs) == len(set(names)) == len(set(expected))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)}


# ---- resharding ---------------------------------------------------------------------------------


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(2)
    for _ in range(60):
        shards = int(rng.integers(1, 5))
        blocks = {}
        for _ in range(int(rng.integers(0, 12))):
            n = int(rng.integers(1, 9))
            blocks[int(rng.integers(0, 6)), int(rng.integers(0, 9))] = (n, n * int(rng.integers(1, 50)))
        blocks = [(*k, *v) for k, v in blocks.items()]
        plan = resharding.solve(blocks, shards)
        rows = sum(b[2] for b in blocks)
        counts, slots = Counter(), defaultdict(list)
        for s in plan.segments:
            counts[s.shard] += s.high - s.low
            slots[s.shard] += range(s.slot, s.slot + s.high - s.low)
        assert all(counts[s] in (rows // shards, -(-rows // shards)) for s in range(shards))
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        # Best by hand: each shard keeps its dearest rows; the shards that keep one more are tried in all ways.
        price = {s: sorted((size / n for o, _, n, size in blocks if o == s for _ in range(n)), reverse=True) for s in range(shards)}
        base, more = rows // shards, rows % shards
        gains = sorted((p[base] if len(p) > base else 0 for p in price.values()), reverse=True)
        best = sum(b[3] for b in blocks) - sum(sum(p[:base]) for p in price.values()) - sum(gains[:more])
        assert plan.moved_bytes == pytest.approx(best, abs=1e-6)


def test_every_row_has_one_place(spark, edge_docs, no_docs, tmp_path):
    docs = edge_docs.withColumn("old", F.pmod(F.hash("text"), F.lit(11)))
    for piece_rows, name in ((2, "a"), (20_000, "b")):
        placed, plan = resharding.place(resharding.prepare(docs, F.col("old"), ["source"]), 8, piece_rows)
        rows = resharding.rewrite(placed, plan, f"{shared_folder(spark)}/reshard-{name}-{tmp_path.name}").collect()
        assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter((r.doc_id, r.text, r.source) for r in docs.collect())
        assert all(r["size"] == len((r.text or "").encode()) + 1 for r in rows)
        counts = Counter(r.shard for r in rows)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
        for shard, n in counts.items():
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
        assert sum(r["size"] for r in rows if r.old != r.shard) <= sum(r["size"] for r in rows)
    placed, plan = resharding.place(resharding.prepare(no_docs, F.lit(0)), 8)
    assert placed.count() == 0 and not plan.segments


# ---- nearest neighbours ---------------------------------------------------------------------------


def exact_nearest(ids, vectors, asked, k=20):
    out = {}
    for q in asked:
        score = {i: float(np.dot(vectors[q], v)) for i, v in vectors.items() if i != q}
        out[q] = sorted(score, key=lambda i: (-score[i], i))[:k]
    return out


def test_nearest_edges(spark):
    rows = [
        (0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [1.0, -0.0], "x"), (3, [0.5, 0.5], "x"), (4, [2.0], "x"),
        (5, None, "x"), (6, [0.0, 0.0], "x"), (7, [float("nan"), 1.0], "x"), (8, [float("inf"), 1.0], "x"),
        (9, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (20, [-1.0, 0.25], None), (40, [], None),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, node string")
    got = nearest.nearest(table, table.select("vec_id").filter("vec_id % 20 = 0")).collect()
    vectors = {0: (1, 0), 1: (1, 0), 2: (1, 0), 3: (0.5, 0.5), 4: (2, 0), 20: (-1, 0.25)}
    vectors = {k: np.array(v, float) for k, v in vectors.items()}
    expected = exact_nearest(list(vectors), vectors, [0, 20])
    for q, best in expected.items():
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [x[1] for x in mine] == best and [x[0] for x in mine] == list(range(1, len(best) + 1))
        assert all(x[2] == pytest.approx(float(np.dot(vectors[q], vectors[x[1]]))) for x in mine)
    assert {r.query_id for r in got} == {0, 20}
    assert nearest.nearest(table.limit(0), table.select("vec_id")).count() == 0


def test_recall_and_copies(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    copies = spark.range(1000, 1060).select(F.col("id").alias("vec_id")).crossJoin(rows.filter("vec_id = 20").select("embedding"))
    table = rows.unionByName(copies)
    got = defaultdict(dict)
    for r in nearest.nearest(table, table.select("vec_id").filter("vec_id % 20 = 0")).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    asked = [i for i in vectors if i % 20 == 0]
    expected = exact_nearest(list(vectors), vectors, asked)
    shared = [len(set(got[q].values()) & set(expected[q])) / 20 for q in asked]
    assert np.mean(shared) >= 0.95
    assert [got[1000][k] for k in range(1, 21)] == [20, *range(1001, 1020)]


# ---- queries and pipeline --------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(expected)


def test_contract_columns(spark):
    columns = {name: queries.QUERIES[name](spark, SF).columns for name in ("op2_reshard", "op3_license_scan", "op4_token_counts")}
    assert columns["op2_reshard"][:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert columns["op4_token_counts"] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = queries.QUERIES["op2_reshard"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def plain_near(texts):
    """Least index of the component of each text, by five-word sets and Jaccard similarity."""
    sets = []
    for text in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return plain_components(sets, lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b))


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == [
        "language_id", "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "packing",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stage = dict(pipeline.STAGES)
    known = stage["language_id"](spark, docs, SF)
    assert known.columns == docs.columns and known.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    good = stage["quality_classifier"](spark, known, SF)
    kept = {r.doc_id for r in good.collect()}
    assert all(d in kept for d, q in labels.items() if q == 1)
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    rows = good.collect()
    least = {}
    for r, root in zip(rows, plain_near([r.text for r in rows]), strict=True):
        least[root] = min(least.get(root, r.doc_id), r.doc_id)
    unique = stage["simhash_near_dedup"](spark, good, SF)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(least.values())
    clean = stage["benchmark_decontamination"](spark, unique, SF)
    dirty = {r.doc_id for r in queries.QUERIES["op6_decontaminate"](spark, SF).filter("contaminated").collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(least.values()) - dirty)
    whole = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in whole} == set(least.values()) - dirty
    assert sum(r.length for r in whole) == sum({r.doc_id: r.doc_tokens for r in whole}.values())


def test_pipeline_on_edge_rows_and_an_empty_table(spark, edge_docs, no_docs):
    import corpus_pipeline as pipeline

    for docs in (edge_docs, no_docs):
        columns = docs.columns
        for name, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns, name
        pieces = pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert sorted({r.doc_id for r in pieces}, key=str) == sorted({r.doc_id for r in docs.collect()}, key=str)


# ---- ties of the nearest neighbours ----------------------------------------------------------------


def test_equal_scores_go_to_the_smaller_id(spark):
    """Sixty vectors with one product with the query: the twenty least ids."""
    rows = [(0, [1.0, 0.0])] + [(k, [0.5, 0.01 * k]) for k in range(1, 61)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = nearest.nearest(table, table.select("vec_id").filter("vec_id = 0")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 21))


def test_binary_vectors_with_many_ties(spark):
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 2, (1500, 64)).astype(float)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(bits)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(nearest.nearest(table, table.select("vec_id").filter("vec_id % 75 = 0")).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
    expected = exact_nearest(range(1500), dict(enumerate(bits)), range(0, 1500, 75))
    assert np.mean([len(set(got[q]) & set(e)) / 20 for q, e in expected.items()]) >= 0.9
