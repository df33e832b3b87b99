"""Cross-entropy difference between a target and a background n-gram model.

Both models are interpolated bigram models of one kind over one vocabulary and one set of stored bigrams; each token of a document
(its end included) has a loss under either, and a document's score is the mean difference, target minus
background, in nats: the lower, the nearer to the target.

Counts are exact and cover all texts. Tasks count their own words and bigrams in bounded buffers that are sent on when
full, and partial counts are summed per word and per bigram, so a hot word is combined before the shuffle. The model that
is broadcast is bounded: words and bigrams from that frequency on which keeps at most ``VOCABULARY`` words and ``BIGRAMS``
bigrams; other words are one unknown word, other bigrams fall back to the unigram. Probabilities sum to one in either case.

``score_background`` has no such bounds: its models keep every word and every bigram. Only the losses of frequent bigrams of frequent
words are broadcast; the other bigrams of a text, with their number, meet the table of all bigrams in a shuffled join. Words outside the
broadcast vocabulary go by 63 bits of their hash.

Rows: a null or empty text is its end alone; null ids stay null; repeated rows are counted and scored each for itself; with an
empty target or background that model is uniform; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import doc_texts, map_batches, stored, utf8, words
from qaloom.session import lookup

VOCABULARY = 32_768
BIGRAMS = 1 << 19
WEIGHT = 0.7  # of the bigram estimate
PSEUDO = 0.5  # added to each unigram count
FLUSH_WORDS = 200_000
FLUSH_TOKENS = 2_000_000
END, UNKNOWN, FIRST = 0, 1, 2  # ids of the text boundary, of unknown words, of the first known word


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.ids) + FIRST

    def encode(self, text: bytes) -> np.ndarray:
        """Boundary, word ids, boundary."""
        return np.array([END, *map(self.ids.get, words(text), repeat(UNKNOWN)), END], np.int64)


@dataclass(frozen=True)
class Models:
    """Two models over the same vocabulary and stored bigrams; arrays have a row per model."""

    vocabulary: Vocabulary
    keys: np.ndarray  # stored bigrams, sorted
    share: np.ndarray  # weighted bigram estimate by stored bigram
    unigram: np.ndarray
    back: np.ndarray  # weight of the unigram by context

    def losses(self, text: bytes) -> tuple[int, float, float]:
        """Words, and mean loss per token under target and background."""
        ids = self.vocabulary.encode(text)
        before, now = ids[:-1], ids[1:]
        key = before * self.vocabulary.size + now
        p = self.unigram[:, now] * self.back[:, before]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            p[:, known] += self.share[:, at[known]]
        target, background = -np.log(p).mean(axis=1)
        return len(ids) - 2, float(target), float(background)


def _counts(kinds: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=kinds)


def _cutoff(counted: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` rows have it or more. The histogram of counts is what is sorted."""
    above, least = 0, None
    for n, rows in counted.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if above + rows > most:
            break
        above, least = above + rows, n
    return least if least is not None else np.iinfo(np.int64).max


def vocabulary(texts: list[DataFrame], most: int = VOCABULARY) -> Vocabulary:
    """The most frequent words over all texts of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in utf8(batch):
                counts.update(words(text))
                if len(counts) > FLUSH_WORDS:
                    yield _counts(["word", "n"], [list(counts), list(counts.values())])
                    counts.clear()
        if counts:
            yield _counts(["word", "n"], [list(counts), list(counts.values())])

    partial = [map_batches(t.select("text"), run, "word binary, n bigint") for t in texts]
    every = partial[0]
    for more in partial[1:]:
        every = every.unionByName(more)
    counted = stored(every.groupBy("word").agg(F.sum("n").alias("n")), "op9-words")
    kept = counted.filter(F.col("n") >= int(_cutoff(counted, most))).select("word").toArrow()["word"].to_pylist()
    return Vocabulary({word: FIRST + i for i, word in enumerate(sorted(kept))})


def _ngrams(texts: DataFrame, shared, model: int) -> DataFrame:
    """Partial counts of bigrams (key) and, as negative keys, of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = shared.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            bigrams = np.concatenate([ids[:-1] * vocab.size + ids[1:] for ids in held])
            keys, n = np.unique(bigrams, return_counts=True)
            single = np.bincount(np.concatenate([ids[1:] for ids in held]), minlength=vocab.size)
            seen = np.flatnonzero(single)
            return _counts(["key", "n"], [np.concatenate([keys, -1 - seen]), np.concatenate([n, single[seen]])])

        for batch in batches:
            for text in utf8(batch):
                held.append(vocab.encode(text))
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = map_batches(texts.select("text"), run, "key bigint, n bigint")
    return counted.select("key", *[F.when(F.lit(m == model), F.col("n")).otherwise(0).alias(f"n{m}") for m in (0, 1)])


def train(target: DataFrame, background: DataFrame, most_words: int = VOCABULARY, most_bigrams: int = BIGRAMS) -> Models:
    """Both models, from all texts of both tables."""
    vocab = vocabulary([target, background], most_words)
    shared = background.sparkSession.sparkContext.broadcast(vocab)
    counted = _ngrams(target, shared, 0).unionByName(_ngrams(background, shared, 1))
    counted = counted.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = stored(counted.withColumn("n", F.col("n0") + F.col("n1")), "op9-ngrams")
    bigrams = counted.filter("key >= 0")
    kept = bigrams.filter(F.col("n") >= int(_cutoff(bigrams, most_bigrams))).select("key", "n0", "n1").toArrow()
    single = counted.filter("key < 0").select("key", "n0", "n1").toArrow()  # at most the vocabulary
    order = np.argsort(kept["key"].to_numpy())
    keys = kept["key"].to_numpy()[order]
    pairs = np.stack([kept[c].to_numpy()[order] for c in ("n0", "n1")]).astype(float)
    words_n = np.zeros((2, vocab.size))
    words_n[:, -1 - single["key"].to_numpy()] = np.stack([single[c].to_numpy() for c in ("n0", "n1")])
    unigram = (words_n + PSEUDO) / (words_n.sum(axis=1, keepdims=True) + PSEUDO * vocab.size)
    # Each occurrence of a word, or of a text's end, is the context of one token: of the next one, or of the next text's first.
    context = keys // vocab.size
    share = WEIGHT * pairs / np.maximum(words_n[:, context], 1)
    back = 1 - np.stack([np.bincount(context, s, minlength=vocab.size) for s in share])
    return Models(vocab, keys, share.astype(np.float32), unigram.astype(np.float32), np.maximum(back, 0).astype(np.float32))


def score(docs: DataFrame, models: Models) -> DataFrame:
    """Words, losses under both models and their difference for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.losses(text) for text in utf8(batch)]
            n, target, background = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(target, pa.float64()), pa.array(background, pa.float64())],
                names=["doc_id", "n_words", "target_loss", "background_loss"],
            )

    scored = map_batches(doc_texts(docs), run, "doc_id bigint, n_words bigint, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def _hashed(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return -1 - (xxh3_64_intdigest(word) >> 1)


def _encode_all(text: bytes, ids: dict[bytes, int]) -> np.ndarray:
    """Boundary, word ids, boundary; words outside the vocabulary have negative ones."""
    found = [ids[w] if w in ids else _hashed(w) for w in words(text)]
    return np.array([END, *found, END], np.int64)


def _distinct_pairs(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
    return v[first], w[first], np.diff(np.append(first, len(v)))


def _all_pairs(texts: DataFrame, shared, model: int) -> DataFrame:
    """Partial counts of all bigrams ``v``, ``w``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            v, w = np.concatenate([i[:-1] for i in held]), np.concatenate([i[1:] for i in held])
            return _counts(["v", "w", "n"], list(_distinct_pairs(v, w)))

        for batch in batches:
            for text in utf8(batch):
                held.append(_encode_all(text, shared.value.ids))
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = map_batches(texts.select("text"), run, "v bigint, w bigint, n bigint")
    return counted.select("v", "w", *[F.when(F.lit(m == model), F.col("n")).otherwise(0).alias(f"n{m}") for m in (0, 1)])


def score_background(target: DataFrame, background: DataFrame, most_words: int = VOCABULARY, most_bigrams: int = BIGRAMS) -> DataFrame:
    """``score`` of every text of ``background`` under models that keep all words and bigrams; the bounds are those of what is broadcast."""
    spark = background.sparkSession
    vocab = vocabulary([target, background], most_words)
    known = spark.sparkContext.broadcast(vocab)
    pairs = _all_pairs(target, known, 0).unionByName(_all_pairs(background, known, 1))
    pairs = stored(pairs.groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "op9-pairs")
    # Each occurrence of a word, or of a text's end, is the context of one token, so these are the words' own counts too.
    single = stored(pairs.groupBy("v").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1")), "op9-contexts")
    total = single.agg(F.count_if(F.col("v") != END), F.sum("c0"), F.sum("c1")).first()
    size = total[0] + FIRST
    unigram = [(F.col(f"c{m}") + PSEUDO) / F.lit((total[m + 1] or 0) + PSEUDO * size) for m in (0, 1)]
    second = single.select(F.col("v").alias("w"), *[u.alias(f"u{m}") for m, u in enumerate(unigram)])
    # Of two known words the counts are looked up in a small table; only pairs with another word meet all words.
    inside = F.col("v").between(0, vocab.size) & F.col("w").between(0, vocab.size)
    small = [stored(x, "op9-known") for x in (single.filter("v >= 0"), second.filter("w >= 0"))]
    seen = [F.col(f"c{m}") > 0 for m in (0, 1)]
    p = [
        F.when(seen[m], WEIGHT * F.col(f"n{m}") / F.col(f"c{m}") + (1 - WEIGHT) * F.col(f"u{m}")).otherwise(F.col(f"u{m}")) for m in (0, 1)
    ]
    lost = [(-F.log(p[m])).alias(f"l{m}") for m in (0, 1)]

    def looked_up(counted: DataFrame) -> DataFrame:
        return counted.join(F.broadcast(small[0]), "v").join(F.broadcast(small[1]), "w")

    least = int(_cutoff(pairs.filter(inside).select((F.col("n0") + F.col("n1")).alias("n")), most_bigrams))
    often = looked_up(pairs.filter(inside & (F.col("n0") + F.col("n1") >= least)))
    held = often.select((F.col("v") * vocab.size + F.col("w")).alias("key"), *lost).toArrow()
    order = np.argsort(held["key"].to_numpy())
    table = spark.sparkContext.broadcast((held["key"].to_numpy()[order], np.stack([held[c].to_numpy()[order] for c in ("l0", "l1")])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, width, (keys, lost) = known.value.ids, known.value.size, table.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            docs, rest = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch), strict=True):
                row += 1
                now = _encode_all(text, ids)
                v, w = now[:-1], now[1:]
                found, sums = np.zeros(len(v), bool), np.zeros(2)
                if len(keys):
                    key = v * width + w
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    found = (keys[at] == key) & (v >= 0) & (w >= 0)
                    sums = lost[:, at[found]].sum(axis=1)
                docs.append((row, doc_id, len(now) - 2, *sums.tolist()))
                if not found.all():
                    v, w, n = _distinct_pairs(v[~found], w[~found])
                    rest.append((np.full(len(v), row), v, w, n))
            if docs:
                none = pa.nulls(len(docs), pa.int64())
                row_, doc, n_words, l0, l1 = zip(*docs, strict=True)
                columns = [pa.array(row_, pa.int64()), pa.array(doc, pa.int64()), pa.array(n_words, pa.int64()), pa.array(l0), pa.array(l1), none, none, none]
                yield pa.RecordBatch.from_arrays(columns, names)
            if rest:
                at, v, w, n = (pa.array(np.concatenate(c)) for c in zip(*rest, strict=True))
                none, zero = pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.float64())
                yield pa.RecordBatch.from_arrays([at, none, none, zero, zero, v, w, n], names)

    names = ["row", "doc_id", "n_words", "l0", "l1", "v", "w", "n"]
    schema = "row bigint, doc_id bigint, n_words bigint, l0 double, l1 double, v bigint, w bigint, n bigint"
    asked = stored(map_batches(doc_texts(background), run, schema), "op9-asked")
    rest = asked.filter("v IS NOT NULL").select("row", "v", "w", F.col("n").alias("k"))
    # A pair of a text that is not among those met otherwise was met there alone.
    more = pairs.filter(inside & (F.col("n0") + F.col("n1") < least) & ~((F.col("n0") == 0) & (F.col("n1") == 1)))
    met = rest.filter(inside).join(more, ["v", "w"], "left").withColumns({"n0": F.coalesce("n0", F.lit(0)), "n1": F.coalesce("n1", F.lit(1))})
    other = pairs.filter(~inside).join(lookup(single, row_bytes=24), "v").join(lookup(second, row_bytes=24), "w").select("v", "w", *lost)
    rest = looked_up(met).select("row", "k", *lost).unionByName(rest.filter(~inside).join(other, ["v", "w"]).select("row", "k", "l0", "l1"))
    rest = rest.groupBy("row").agg(*[F.sum(F.col("k") * F.col(f"l{m}")).alias(f"r{m}") for m in (0, 1)])
    whole = asked.filter("v IS NULL").select("row", "doc_id", "n_words", "l0", "l1").join(rest, "row", "left")
    mean = [((F.col(f"l{m}") + F.coalesce(f"r{m}", F.lit(0.0))) / (F.col("n_words") + 1)) for m in (0, 1)]
    scored = whole.select("doc_id", "n_words", mean[0].alias("target_loss"), mean[1].alias("background_loss"))
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
