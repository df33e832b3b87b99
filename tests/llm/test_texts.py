"""Operators that read whole texts, against plain loops over the same rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from qaloom.llm import decontaminate, language, licenses, lm_score, packing, quality, token_counts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def same(got, expected):
    return Counter(map(tuple, got)) == Counter(map(tuple, expected))


# ---- licence scan -----------------------------------------------------------------------------


def places(text):
    w = words(text)
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return w, found


def test_base_places_equal_a_plain_search(edge_docs):
    got = [tuple(r)[:6] for r in licenses.digest(licenses.scan(edge_docs)).collect()]
    expected = []
    for r in edge_docs.collect():
        w, found = places(r.text)
        starts = [i for i, _ in found]
        labels = ",".join(sorted({x for _, x in found}))
        expected.append((r.doc_id, len(w), len(found), min(starts, default=None), max(starts, default=None), labels))
    assert same(got, expected)


def test_method_adds_labels_and_scores(spark):
    texts = {
        1: "# SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode",
        2: "SPDX-License-Identifier: Apache-2.0 AND (GPL-2.0-only WITH Classpath-exception-2.0)",
        3: "SPDX-License-Identifier: MIT OR",
        4: "Licensed under the Apache License, Version 2.0.",
        5: "nothing",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.digest(licenses.scan(rows)).collect()}
    assert got[1] == ("gpl-2.0-only,mit", 1.0)
    assert got[2] == ("apache-2.0,classpath-exception-2.0,gpl-2.0-only", 0.7)
    assert got[3] == ("unparsed", 0.0)
    assert got[4] == ("apache-2.0", 1.0)
    assert got[5] == ("", 0.0)


@pytest.mark.parametrize("bad", ["", "AND MIT", "(MIT", "MIT)", "MIT GPL", "MIT OR", "()", "MIT (GPL)", "MIT & GPL"])
def test_malformed_expressions(bad):
    with pytest.raises(ValueError):
        licenses.evaluate(bad)


def test_precedence():
    assert licenses.postfix("a OR b AND c WITH d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]


# ---- token counts and packing -------------------------------------------------------------------


def odd_texts():
    random.seed(3)
    letters = "aAé ß'<|>1²\t\n\x1c　́Σİ▁.-s"
    made = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(800)]
    return [*made, "<|endoftext|> a<|startoftext|>b <|", "don't it's", "x" * 700 + " y", "a  b ", "  ", "<s> </s>", "a\x00b"]


def test_token_counts_equal_the_library(spark, edge_docs, no_docs):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    rows = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id bigint, text string")
    for docs in (edge_docs, rows):
        got = [tuple(r) for r in token_counts.count(docs, PIECES, size=50).collect()]
        expected = []
        for r in docs.select("doc_id", "text").collect():
            n = len(model.encode(r.text or ""))
            expected.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
        assert same(got, expected)
    assert token_counts.count(no_docs, PIECES).count() == 0


def test_small_caches_change_nothing(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED", 5)
    monkeypatch.setattr(token_counts, "CACHED", 5)
    library = Tokenizer.from_file(BPE)
    chunks, lengths = packing.ChunkIds(BPE), token_counts.Lengths(PIECES, {"a": 1})
    texts = odd_texts()[:120]
    for i in range(0, len(texts), 7):
        for text, ids in zip(texts[i : i + 7], chunks.of(texts[i : i + 7]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
            expected = len(token_counts.model(PIECES).encode(text))
            assert sum(map(lengths.__getitem__, token_counts.pretokens(text))) == expected


@pytest.mark.parametrize("limits", [(2048, 256, None), (16, 3, None), (16, 4, 9)])
def test_packing_is_an_exact_round_trip_within_all_limits(spark, edge_docs, limits):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    tokens, segments, loss = limits
    docs = edge_docs.filter("doc_id <> 6 or doc_id is null").drop("size").withColumnRenamed("n_chars", "prompt")
    docs = docs.unionByName(
        spark.createDataFrame([(100 + i, t, None) for i, t in enumerate(odd_texts()[:60])], "doc_id bigint, text string, prompt bigint"),
        allowMissingColumns=True,
    )
    rows = packing.pack(docs, BPE, tokens, segments, loss, prompt_tokens="prompt").collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for r in docs.select("doc_id", "text").distinct().collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        covered = Counter()
        for p in by_doc[r.doc_id]:
            assert p.doc_tokens == len(ids)
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length]
            covered.update(range(p.start, p.start + p.length))
        assert set(covered) == set(range(len(ids))) and len(set(covered.values())) == 1
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) <= tokens and len(pieces) <= segments
        assert sum(p.loss_tokens for p in pieces) <= (loss or tokens)
    digests = packing.digest(packing.pack(docs, BPE, tokens, segments, loss, prompt_tokens="prompt")).collect()
    checksums = Counter((r.doc_id, r.start, zlib.crc32(r.ids)) for r in rows)
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in digests) == checksums


def test_packing_leaves_little_padding(spark):
    random.seed(1)
    docs = spark.createDataFrame(
        [(i, "word " * random.randint(1, 900)) for i in range(400)], "doc_id bigint, text string"
    ).coalesce(1)
    rows = packing.pack(docs, BPE).collect()
    assert sum(r.length for r in rows) / (2048 * len({r.sequence_id for r in rows})) > 0.97


@pytest.mark.parametrize("limits", [(64, 8, 64), (64, 3, 40)])
def test_each_sequence_is_packed_by_the_plain_rule(limits):
    rng = random.Random(5)
    bins, rows = packing.Bins(0, limits), []
    for i in range(300):
        n, prompt = rng.randrange(1, 60), rng.randrange(30)
        bins.add(i, bytes(4 * n), prompt)
    plain = list(bins.open)
    bins.rows, first = [], bins.next_id
    bins.pack(0)
    while plain:
        space = list(limits)
        while plain and min(space[:2]) >= 1:
            demands = [(len(p[2]) // 4, 1, packing.Bins.loss(p[1], len(p[2]) // 4, p[4])) for p in plain]
            fit = [k for k, d in enumerate(demands) if all(x <= y for x, y in zip(d, space, strict=True))]
            if fit:
                worth = [round(sum(x * y / z**2 for x, y, z in zip(demands[k], space, limits, strict=True)), 9) for k in fit]
                got = bins.rows[len(rows)]
                k = next(k for k in fit if plain[k][:2] == got[:2])
                assert worth[fit.index(k)] == max(worth) and got[2] == demands[k][0]
                size, rest = demands[k][0], []
            else:
                if space[0] < packing.LEAST_CUT:
                    break
                k = max(range(len(plain)), key=lambda k: demands[k][0])
                doc_id, start, ids, total, prompt = plain[k]
                size = bins.most(start, prompt, min(space[0], demands[k][0] - 1), space[2])
                if size < 1:
                    break
                rest = [(doc_id, start + size, ids[4 * size :], total, prompt)]
            got = bins.rows[len(rows)]
            assert got[:3] == (*plain[k][:2], size) and got[5] == first and got[6] == limits[0] - space[0]
            space = [space[0] - size, space[1] - 1, space[2] - got[7]]
            plain[k : k + 1] = rest
            rows.append(got)
        first += 1
    assert rows == bins.rows


# ---- decontamination --------------------------------------------------------------------------


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(item)
    lengths = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if items_of := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= items_of
        names = sorted(str(i) for i in found if i is not None)
        yield doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 3])
def test_decontamination_equals_brute_force(spark, edge_docs, no_docs, block):
    items = [
        (1, "The QUICK brown fox jumps over the lazy dog and all the rest"),
        (2, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma"),
        (3, "x"),
        (4, None),
        (5, "..."),
        (5, "a text without"),
        (None, "12345 67890"),
        (7, "Größe ÄÖÜ"),
        (7, "Größe ÄÖÜ"),
        (8, "größe äöü"),
    ]
    benchmark = spark.createDataFrame([(*i, "extra") for i in items], "item_id bigint, text string, window string")
    pairs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = decontaminate.digest(decontaminate.scan(edge_docs, benchmark, block=block)).collect()
    assert same(got, contamination(pairs, items))
    none = spark.createDataFrame([], benchmark.schema)
    assert same(decontaminate.digest(decontaminate.scan(edge_docs, none)).collect(), contamination(pairs, []))
    assert decontaminate.scan(no_docs, benchmark).count() == 0


def test_documents_and_spans_are_removed(spark, edge_docs):
    benchmark = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and all")], "item_id bigint, text string")
    kept = decontaminate.remove_documents(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in edge_docs.collect() if r.doc_id not in (1, 2))
    spans = {r.doc_id: r.text for r in decontaminate.remove_spans(edge_docs, benchmark).collect()}
    assert spans[1] == "The rights reserved."
    assert spans[8] == "12345 67890 --- !!!" and spans[3] is None


# ---- models -----------------------------------------------------------------------------------


def test_language_models_edges(edge_docs, no_docs):
    model = language.fit(edge_docs)
    rows = language.identify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r.doc_id: r for r in rows}
    for doc in (3, 4, 5, 8):
        assert (by_id[doc].lang_pred, by_id[doc].score) == ("und", 0.0)
    assert by_id[None].held_out is False
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.lang_pred in (*model.languages, "und") for r in rows)
    assert language.fit(no_docs).languages == ()
    assert {r.lang_pred for r in language.identify(edge_docs, language.fit(no_docs)).collect()} == {"und"}
    assert language.keep_known(edge_docs, model, 0.0).columns == edge_docs.columns


def test_kernel_counts_shared_ngrams():
    bits = language.presence(["abcab", "", "ABCAB", "é" * 9])
    assert bits[0].sum() == 3 + 3 + 3 and (bits[0] == bits[2]).all() and not bits[1].any() and bits[3].sum() == 3


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs, language.fit(docs)).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(1, 9)] + [(None, 1, 1, None), (2, None, None, None)], "doc_id bigint, quality int, toxic int, text string")
    rows = quality.score(edge_docs, quality.fit(edge_docs, labels)).collect()
    assert len(rows) == edge_docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    none = quality.fit(no_docs, labels.limit(0))
    assert none.prior == 0.5 and quality.score(no_docs, none).count() == 0
    assert quality.keep_good(edge_docs, none).columns == edge_docs.columns


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score(docs, quality.fit(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    positive = rng.normal(0.2, 0.05, (300, 6))
    unlabelled = np.concatenate([rng.normal(0.2, 0.05, (600, 6)), rng.normal(-0.2, 0.05, (400, 6))])
    scores = quality.minimise(positive, unlabelled, 0.6).scores(unlabelled)
    assert (scores[:600] > 0.5).mean() > 0.95 and (scores[600:] < 0.5).mean() > 0.95


def test_language_models_equal_a_plain_count(spark, edge_docs, no_docs):
    target = spark.createDataFrame([("the fox and the dog",), (None,), ("fox fox",)], "text string")
    docs = edge_docs.filter("doc_id <> 6 or doc_id is null")
    most_words, most_bigrams = 12, 9
    rows = lm_score.score(docs, lm_score.train(target, docs, most_words, most_bigrams)).collect()
    texts = [[words(r.text) for r in target.collect()], [words(r.text) for r in docs.collect()]]
    count = Counter(w for side in texts for t in side for w in t)

    def cut(counter, most):
        for least in range(1, max(counter.values()) + 2):
            if sum(n >= least for n in counter.values()) <= most:
                return {k for k, n in counter.items() if n >= least}

    known = cut(count, most_words)
    marked = [[["</s>", *(w if w in known else "<unk>" for w in t), "</s>"] for t in side] for side in texts]
    grams = [Counter(p for t in side for p in zip(t, t[1:], strict=False)) for side in marked]
    single = [Counter(w for t in side for w in t[1:]) for side in marked]
    kept = cut(grams[0] + grams[1], most_bigrams)
    size = len(known) + 2

    def p(m, v, w):
        uni = (single[m][w] + 0.5) / (sum(single[m].values()) + 0.5 * size)
        share = {g: 0.7 * grams[m][g] / max(1, single[m][g[0]]) for g in kept if g[0] == v}
        return share.get((v, w), 0) + (1 - sum(share.values())) * uni

    expected = Counter()
    for r in docs.collect():
        t = ["</s>", *(w if w in known else "<unk>" for w in words(r.text)), "</s>"]
        loss = [-np.mean([np.log(p(m, v, w)) for v, w in zip(t, t[1:], strict=False)]) for m in (0, 1)]
        expected[(r.doc_id, len(t) - 2, round(loss[0], 3), round(loss[1], 3))] += 1
    got = Counter((r.doc_id, r.n_words, round(r.target_loss, 3), round(r.background_loss, 3)) for r in rows)
    assert got == expected
    assert all(abs(r.score - (r.target_loss - r.background_loss)) < 1e-12 for r in rows)
    assert lm_score.score(no_docs, lm_score.train(target.limit(0), no_docs)).count() == 0


@pytest.mark.parametrize("most_words,most_bigrams", [(0, 0), (3, 2), (1000, 5), (1000, 1000)])
def test_no_word_or_bigram_is_dropped_by_what_is_broadcast(spark, edge_docs, no_docs, most_words, most_bigrams):
    target = spark.createDataFrame([("the fox and the dog",), (None,), ("fox fox",)], "text string")
    docs = edge_docs.filter("doc_id <> 6 or doc_id is null")
    whole = lm_score.score(docs, lm_score.train(target, docs, 1 << 20, 1 << 20))
    got = lm_score.score_background(target, docs, most_words, most_bigrams)
    assert got.columns == whole.columns
    rows = [Counter((r.doc_id, r.n_words, round(r.target_loss, 3), round(r.background_loss, 3)) for r in x.collect()) for x in (got, whole)]
    assert rows[0] == rows[1]
    assert lm_score.score_background(target, no_docs).count() == 0


def test_a_worker_holds_no_cache_that_is_not_kept(spark):
    import pyarrow as pa

    docs = spark.range(40).selectExpr("id AS doc_id", "concat('word ', id, ' again') AS text").repartition(4)
    held, own = (packing.digest(packing.pack(docs, BPE, cached=777, kept=k)) for k in (True, False))
    facts = ("doc_id", "length", "ids_crc32", "doc_tokens")

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"entries": [entries for _, entries in packing._chunks] * batch.num_rows})

    assert sorted(own.select(*facts).collect()) == sorted(packing.digest(packing.pack(docs, BPE)).select(*facts).collect())
    entries = {r.entries for r in spark.range(40).repartition(4).mapInArrow(left, "entries bigint").collect()}
    assert 777 not in entries
    assert sorted(held.select(*facts).collect()) == sorted(own.select(*facts).collect())
