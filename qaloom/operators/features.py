"""TF-IDF, naive Bayes and prior baselines as grouped counts, and ML-vector features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions import draws
from qaloom.functions.staging import let
from qaloom.functions.text import counted
from qaloom.operators.ranking import join_on
from qaloom.session import checkpoint, lookup

# Words of two characters or more, in any script.
TERM = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"
KNOWN = 200_000  # words whose pairs are counted as numbers, at most
FLUSH = 200_000  # words a task holds before it sends their counts on
HELD = 2_000_000  # pairs it holds
PIECE = 1024  # rows it looks at together


def ngrams(text: Column, largest: int = 2) -> Column:
    """Lower-cased words and their n-grams up to ``largest``, repeats kept."""

    def of_size(terms: Column, n: int) -> Column:
        starts = F.when(
            F.size(terms) >= n, F.sequence(F.lit(1), F.size(terms) - n + 1)
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(terms, i, n), " "))

    def grams(terms: Column) -> Column:
        return F.concat(terms, *[of_size(terms, n) for n in range(2, largest + 1)])

    found = words(text)
    return found if largest == 1 else let(found, grams)


def words(text: Column) -> Column:
    """The lower-cased words alone, repeats kept, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def term_counts(df: DataFrame, keep: list[str], text: str, largest: int = 2) -> DataFrame:
    """(keep..., term, tf), counted inside each document's row; nothing is shuffled."""
    return df.select(*keep, F.inline(counted(ngrams(F.col(text), largest))))


def vocabulary(df: DataFrame, text: str, max_terms: int = 10_000, largest: int = 2, copies: str | None = None) -> DataFrame:
    """The corpus's most frequent terms: (term, total, df), ties by term. A row counts ``copies`` times.

    One pass and one aggregate per term, summed where the documents are read: what is shuffled is
    a partial vocabulary per task, not the corpus.
    """
    times = F.col(copies) if copies else F.lit(1)
    sums = term_counts(df, [copies] if copies else [], text, largest).groupBy("term")
    sums = sums.agg(F.sum(F.col("tf") * times).alias("total"), F.sum(times).cast("bigint").alias("df"))
    return sums.orderBy(F.desc("total"), "term").limit(max_terms)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.DictionaryArray, np.ndarray]]:
    """Parts of batches with ``__words``, these words as numbers, and the row of each."""
    for batch in batches:
        for at in range(0, len(batch), PIECE):
            part = batch.slice(at, PIECE)
            lists = part.column("__words")
            found = lists.flatten().dictionary_encode()
            yield part, found, np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))


def _summed(key: np.ndarray, total: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, place = np.unique(key, return_inverse=True)
    sums = np.zeros((2, len(key)), np.int64)
    np.add.at(sums[0], place, total)
    np.add.at(sums[1], place, df)
    return key, sums[0], sums[1]


def _adjacent(number: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of known words that stand side by side in a row: their rows, and first * size + second."""
    if not len(number):
        return row, number
    met = (row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)
    return row[1:][met], (number[:-1] * size + number[1:])[met]


def frequent_terms(rows: DataFrame, max_terms: int = 10_000, pairs: bool = True) -> list[tuple[str, int, int]] | None:
    """The most frequent words of ``__words``, and of their pairs: (term, total, df), by falling total, ties by term.

    A row counts ``copies`` times. Words are counted first. A pair is no more frequent than either of its words, so only pairs of words
    that reach the total of the last word kept can be among the terms: those words become numbers, and pairs are counted as
    numbers, without their texts. None if more than ``KNOWN`` words reach it, which only a corpus of rare words has.
    """

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def sent() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, ["term", "total", "df"])

        for part, found, row in _pieces(batches):
            if not len(found):
                continue
            copies, size = part.column("copies").to_numpy(), len(found.dictionary)
            code, tf = np.unique(row * size + found.indices.to_numpy(), return_counts=True)
            row, word = np.divmod(code, size)
            _, total, df = _summed(word, tf * copies[row], copies[row])
            for w, t, d in zip(found.dictionary.to_pylist(), total.tolist(), df.tolist(), strict=True):
                at = held.setdefault(w, [0, 0])
                at[0] += t
                at[1] += d
            if len(held) > FLUSH:
                yield sent()
                held.clear()
        if held:
            yield sent()

    rows = rows.select("__words", F.col("copies").cast("bigint").alias("copies"))
    sums = [F.sum("total").alias("total"), F.sum("df").alias("df")]
    single = checkpoint(rows.mapInArrow(count_words, "term string, total bigint, df bigint").groupBy("term").agg(*sums))
    top = [tuple(r) for r in single.orderBy(F.desc("total"), "term").limit(max_terms).collect()]
    if not pairs or not top:
        return top
    least = top[-1][1] if len(top) == max_terms else 0
    able = single.where(F.col("total") >= least).select("term").limit(KNOWN + 1).toArrow()["term"].to_pylist()
    if len(able) > KNOWN:
        return None
    able.sort()  # so that the order of the numbers of pairs is that of their texts
    size = len(able)
    shared = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(able)})

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = shared.value, [], 0

        def sent() -> pa.RecordBatch:
            columns = _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pair", "total", "df"])

        for part, found, row in _pieces(batches):
            if not len(found):
                continue
            known = np.fromiter((number.get(w, -1) for w in found.dictionary.to_pylist()), np.int64, len(found.dictionary))
            row, pair = _adjacent(known[found.indices.to_numpy()], row, size)
            code, tf = np.unique(row * size**2 + pair, return_counts=True)
            row, pair = np.divmod(code, size**2)
            copies = part.column("copies").to_numpy()[row]
            held.append((pair, tf * copies, copies))
            n += len(pair)
            if n > HELD:
                yield sent()
                held, n = [], 0
        if held:
            yield sent()

    double = rows.mapInArrow(count_pairs, "pair bigint, total bigint, df bigint").groupBy("pair").agg(*sums)
    double = double.where(F.col("total") >= least).orderBy(F.desc("total"), "pair").limit(max_terms)
    top += [(f"{able[r[0] // size]} {able[r[0] % size]}", r[1], r[2]) for r in double.collect()]
    return sorted(top, key=lambda t: (-t[1], t[0]))[:max_terms]


def top_terms(df: DataFrame, text: str, max_terms: int = 10_000, largest: int = 2, copies: str | None = None) -> list[tuple[str, int, int]]:
    """``vocabulary`` as a list; words and pairs by ``frequent_terms``."""
    found = None
    if largest <= 2:
        times = F.col(copies) if copies else F.lit(1)
        found = frequent_terms(df.select(words(F.coalesce(F.col(text), F.lit(""))).alias("__words"), times.alias("copies")), max_terms, largest == 2)
    return [tuple(r) for r in vocabulary(df, text, max_terms, largest, copies).collect()] if found is None else found


def weighed(
    train: DataFrame, rows: DataFrame, keep: list[str], text: str, max_terms: int = 10_000, largest: int = 2, named: bool = False,
    copies: str | None = None,
) -> tuple[DataFrame, int]:
    """M1/M2: (keep..., indices, values), the TF-IDF weights of each row's text under a vocabulary fitted on ``train``, and the number of terms.

    With ``named``: (keep..., term, weight), a row per term. Weight = (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), scaled to unit
    length. Words are cut by Spark's own expressions; they are paired, counted, looked up, weighed and scaled inside their row, in
    Arrow batches, so nothing is shuffled. What is broadcast is the vocabulary, at most ``max_terms`` terms. A row of ``train``
    counts ``copies`` times.
    """
    n_docs = train.agg(F.sum(copies)).first()[0] or 0 if copies else train.count()
    terms = [(term, math.log((1 + n_docs) / (1 + df)) + 1) for term, _, df in top_terms(train, text, max_terms, largest, copies)]
    terms.sort()
    paired = largest == 2
    units = sorted({w for term, _ in terms for w in (term.split(" ") if paired else [term])})
    number = {w: i for i, w in enumerate(units)}
    alone, pairs = np.full(len(units), -1), []
    for k, (term, _) in enumerate(terms):
        first, *second = (number[w] for w in (term.split(" ") if paired else [term]))
        if second:
            pairs.append((first * len(units) + second[0], k))
        else:
            alone[first] = k
    pairs.sort()
    codes, named_by = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    shared = train.sparkSession.sparkContext.broadcast((number, alone, codes, named_by, [t for t, _ in terms], np.array([idf for _, idf in terms])))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, alone, codes, named_by, terms, idf = shared.value
        names = pa.array(terms, pa.string())
        for part, found, row in _pieces(batches):
            known = np.fromiter((number.get(t, -1) for t in found.dictionary.to_pylist()), np.int64, len(found.dictionary))
            word = known[found.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
            index = np.append(alone, -1)[word]
            if len(codes):
                more, pair = _adjacent(word, row, len(alone))
                at = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
                row = np.append(row, more)
                index = np.append(index, np.where(codes[at] == pair, named_by[at], -1))
            # One entry for each known term of a row, in the order of rows and terms.
            entries, tf = np.unique((row * len(terms) + index)[index >= 0], return_counts=True)
            row, index = np.divmod(entries, max(1, len(terms)))
            raw = (1 + np.log(tf)) * idf[index]
            raw /= np.sqrt(np.bincount(row, raw**2, len(part)))[row]
            if named:
                kept = [part.column(c).take(pa.array(row)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, names.take(pa.array(index)), pa.array(raw)], [*keep, "term", "weight"])
                continue
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(part)))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (index.astype(np.int32), raw)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *lists], [*keep, "indices", "values"])

    told = F.coalesce(F.col(text), F.lit(""))
    slim = rows.select(*keep, (words(told) if largest <= 2 else ngrams(told, largest)).alias("__words"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    more = "term string, weight double" if named else "indices array<int>, values array<double>"
    return slim.mapInArrow(weigh, fields + more), len(terms)


def tfidf(
    train: DataFrame, other: DataFrame, key: str, text: str, max_terms: int = 10_000, largest: int = 2
) -> DataFrame:
    """M1/M2: (key, term, weight) of ``other`` under a vocabulary fitted on ``train`` only; see ``weighed``."""
    return weighed(train, other, [key], text, max_terms, largest, named=True)[0]


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """M4: balanced weights n / (k * n_class) as a column of the input."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(F.lit(0))  # one row per class
    weights = counts.select(
        label, (F.sum("__n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("__n"))).alias(name)
    )
    return join_on(df, lookup(weights), [label])


def naive_bayes(
    train: DataFrame,
    other: DataFrame,
    key: str,
    text: str,
    label: str,
    alpha: float = 1.0,
    max_terms: int = 10_000,
    largest: int = 1,
) -> DataFrame:
    """M6: multinomial naive Bayes on term counts; (key, prediction, score) of every document.

    Training is one aggregate: per term, its count in each class. The model that is left is at
    most max_terms rows of a few numbers; scoring is a broadcast join and one sum per document.
    """
    sizes = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # one row per class
    classes = sorted(sizes)
    per = term_counts(train, [label], text, largest).groupBy("term")
    per = per.agg(
        F.sum("tf").alias("total"),
        *[F.sum(F.when(F.col(label) == c, F.col("tf")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(classes)],
    )
    top = per.orderBy(F.desc("total"), "term").limit(max_terms)
    model = lookup(top, max_rows=max_terms, row_bytes=64 + 8 * len(classes))
    sums = model.agg(F.count(F.lit(1)), *[F.sum(f"n{i}") for i in range(len(classes))]).first()
    mass = [(n or 0) + alpha * sums[0] for n in sums[1:]]
    n_docs = sum(sizes.values())
    # log P(term | class) is its value for an unseen term plus a gain; unseen terms gain nothing.
    gains = [F.log((F.col(f"n{i}") + alpha) / alpha).alias(f"g{i}") for i in range(len(classes))]
    scored = (
        term_counts(other, [key], text, largest)
        .join(model.select("term", *gains), "term")
        .groupBy(key)
        .agg(
            F.sum("tf").alias("n"),
            *[F.sum(F.col("tf") * F.col(f"g{i}")).alias(f"s{i}") for i in range(len(classes))],
        )
    )
    rows = other.select(key).join(scored, key, "left").fillna(0)

    def score(i: int, name: str) -> Column:
        prior = math.log(sizes[name] / n_docs)
        unseen = math.log(alpha / mass[i])
        total = F.lit(prior) + F.col("n") * F.lit(unseen) + F.col(f"s{i}")
        return F.struct(total.alias("score"), F.lit(name).alias("label"))

    best = F.array_max(F.array(*[score(i, c) for i, c in enumerate(classes)]))
    return rows.withColumn("__best", best).select(
        key, F.col("__best.label").alias("prediction"), F.col("__best.score").alias("score")
    )


def prior_baselines(train: DataFrame, other: DataFrame, key: str, label: str, seed: str = "prior") -> DataFrame:
    """Adds ``majority`` (most frequent class) and ``by_prior`` (a draw from class shares).

    The class table is one array on one row; each document looks its draw up in it.
    """
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    steps = counts.select(
        label, "n", (F.sum("n").over(upto) / F.sum("n").over(whole)).alias("upto")
    )
    table = steps.agg(
        F.sort_array(F.collect_list(F.struct("upto", label))).alias("__steps"),
        F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("majority"),
    ).withColumn("__one", F.lit(0))
    u = draws.unit(seed, F.col(key))
    hit = F.get(F.filter("__steps", lambda s: s["upto"] > F.col("__u")), F.lit(0))
    rows = other.withColumns({"__one": F.lit(0), "__u": u}).join(F.broadcast(table), "__one")
    return rows.withColumn("by_prior", hit[label]).drop("__one", "__u", "__steps")


def embedding_vector(column: str) -> Column:
    """M3: an embedding array as an ML vector of unit length; a zero vector stays zero."""
    from pyspark.ml.functions import array_to_vector

    length = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return array_to_vector(F.transform(column, lambda x: F.when(length > 0, x / length).otherwise(0.0)))


def check_embeddings(df: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """Keys of ``df`` without an embedding; empty means the store is complete."""
    return df.select(key).join(embeddings.select(key), key, "left_anti")
