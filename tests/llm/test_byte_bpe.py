"""Byte-level BPE against the tokenizer library, and its round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from qaloom.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def classes():
    return byte_bpe.library_classes()


def ids(binary):
    return np.frombuffer(binary, "<u4").tolist()


def test_hostile_strings(library, classes):
    rng = random.Random(1)
    parts = " |  |\n|\t|'|''|'s|'re|'ll|'l|'ve|'v|'S|'t|'d|'m|a|b|re|ll|s|é|日|本|1|٣|½|!|?|...|\x1c|\x85| |　|\xa0|😀|́|\U00010d40|Ɤ|\x00|\r\n|<|endoftext"
    parts = [*parts.split("|"), "|"]
    merged = byte_bpe.Ranks(byte_bpe.read_ranks(PATH))
    for _ in range(100):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(100)]
        assert [ids(i) for i in merged.encode(texts, classes)] == list(map(library.encode_ordinary, texts))


def test_long_pieces(library, classes):
    rng = random.Random(2)
    letters = "".join(rng.choice("abcdefghij") for _ in range(20_000))
    texts = ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "\n" * 4000, "!" * 2500, "日本" * 2000, letters, letters[:32], letters[:33], letters[:65]]
    merged = byte_bpe.Ranks(byte_bpe.read_ranks(PATH))
    assert [ids(i) for i in merged.encode(texts, classes)] == list(map(library.encode_ordinary, texts))


def test_small_vocabulary_merges_as_the_library(classes):
    """Ranks that are no chain of merges: pieces are still merged by least rank, leftmost first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"aa": 259, b"cab": 260, b"aaa": 261}
    small = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    assert [ids(i) for i in byte_bpe.Ranks(ranks).encode(texts, classes)] == list(map(small.encode_ordinary, texts))


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op12_byte_bpe"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        expected = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(expected), hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edge_rows_and_parts(spark, edge_docs, no_docs, library):
    encoded = byte_bpe.encode(edge_docs, PATH)
    texts = sorted(((r.doc_id, r.text or "") for r in edge_docs.collect()), key=str)
    got = sorted(((r.doc_id, bytes(r.decoded).decode(), ids(r.ids)) for r in byte_bpe.decode(encoded, PATH).collect()), key=str)
    assert [g[:2] for g in got] == texts
    assert all(g[2] == library.encode_ordinary(g[1]) for g in got)
    whole = {r.doc_id: (r.text or "").encode() for r in edge_docs.collect()}
    for r in byte_bpe.decode(encoded.withColumn("a", F.lit(2)).withColumn("b", F.lit(5)), PATH, "a", "b").collect():
        assert whole[r.doc_id][r.start : r.start + len(r.decoded)] == bytes(r.decoded) == library.decode_bytes(ids(r.ids)[2:5])
    assert byte_bpe.digest(byte_bpe.decode(byte_bpe.encode(no_docs, PATH), PATH)).count() == 0
