"""Near copies of the pipeline's stage against brute force over all pairs."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import pytest
from qaloom.llm import near_copies
from qaloom.llm.common import spaced_words


def plain_set(text):
    w = spaced_words((text or "").encode())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_later(rows):
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return {r[0] for i, r in enumerate(rows) if r[0] is not None and r[0] != least[top(i)]}


def later(stage, df):
    kept = {r.doc_id for r in stage(df.sparkSession, df, "").collect()}
    return {r.doc_id for r in df.select("doc_id").collect() if r.doc_id is not None} - kept


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_equals_brute_force_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    assert later(corpus_pipeline.near_duplicates, docs) == plain_later([tuple(r) for r in docs.collect()])


def test_stage_finds_copies_well_beyond_three_bits(spark, edge_docs, no_docs):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        changed = list(words)
        for at in range(20, 20 + 40 * (k % 5), 40):  # up to four single words: similarity 1 to 0.81
            changed[at] = "other"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert later(corpus_pipeline.near_duplicates, df) == plain_later(rows) == set(range(1, 120, 2))
    edges = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert later(corpus_pipeline.near_duplicates, edge_docs) == plain_later(edges)
    assert near_copies.keep_first(no_docs).count() == 0


def test_every_pair_of_a_bucket_is_settled(spark, monkeypatch):
    """One bucket for all: what the least member does not resemble is still compared with each other."""
    monkeypatch.setattr(near_copies, "MET", 4)
    monkeypatch.setattr(near_copies, "buckets", lambda hashes: [7])
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    texts += [t + " end" for t in texts[3:9]] + [t + " end of it" for t in texts[5:7]]
    rows = [(i, t) for i, t in enumerate(texts)]
    nodes = near_copies._signatures(spark.createDataFrame(rows, "doc_id bigint, text string"))
    nodes = near_copies.stored(nodes.drop("doc_id"), "test-nodes")
    monkeypatch.setattr(near_copies, "_trie_pairs", lambda nodes: nodes.select(nodes.node.alias("u"), nodes.node.alias("v")).limit(0))
    got = {frozenset(r) for r in near_copies.components(near_copies.links(nodes, spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    node = {i: r.node for i, r in enumerate(sorted(nodes.collect(), key=lambda r: texts.index(by_key(texts, r.key))))}
    groups = [{node[i], node[i + 9]} | ({node[i + 13]} if 5 <= i < 7 else set()) for i in range(3, 9)]
    assert {x for pair in got for x in pair} == set().union(*groups)
    assert all(any(pair <= g for g in groups) for pair in got) and len({min(g) for g in groups}) == 6


def by_key(texts, key):
    return next(t for t in texts if hashlib.sha256(t.encode()).digest() == bytes(key))


def test_rows_are_removed_and_not_keys(spark):
    """Several texts of one id, copies of ids, repeated rows and rows without an id."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, b, 1), (5, a, 2), (5, b, 3), (9, a, 4), (None, a, 5), (None, c, 6), (7, c, 7), (7, c, 7), (7, c, 8), (8, c, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key int")
    got = sorted(tuple(r)[:2] for r in near_copies.keep_first(df).collect() if r.doc_id is not None)
    assert got == [(3, b), (5, a), (7, c)]
    assert sorted(r.key for r in near_copies.keep_first(df).collect() if r.doc_id is None) == [5, 6]


def test_buckets_agree_as_often_as_theory_says():
    rng = np.random.default_rng(5)
    met = []
    for _ in range(300):
        words = rng.integers(0, 1 << 63, 900).astype(np.uint64) * np.uint64(2)
        a, b = np.unique(words[:800]), np.unique(words[100:])
        met.append(np.mean([x == y for x, y in zip(near_copies.buckets(a), near_copies.buckets(b))]))
    assert np.mean(met) == pytest.approx((700 / 900) ** 5, abs=0.03)
