"""Benchmark decontamination with DataFrame functions only.

Windows of ten item words (a shorter item is one window) become a table of distinct windows: hash, words. It
is broadcast in blocks of at most ``BLOCK`` windows, so the broadcast has a fixed bound and a larger benchmark
takes more passes, not more memory. Document words are scanned in place: positions are generated from the word array
inside one stage, each window's hash meets the broadcast table, and a hit counts only if the words
themselves are equal. Only hits and one marker per document are shuffled.

Rows: null texts have no words; every row of the documents is scanned for itself, also rows that share
or lack a ``doc_id``; repeated items count once per ``item_id``, and an item without an id hits words but cannot be
counted or named; empty tables on either side give no hits; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import stored
from qaloom.session import lookup

WINDOW = 10
BLOCK = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# What stands before a word, and the word, in a text that is not lowered.
_SEGMENT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """A-Z lowered, then the runs of digits, a-z and non-ASCII characters."""
    # ``lower`` has a fast way for ASCII; other texts keep their non-ASCII capitals by ``translate``.
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _BETWEEN), "")


def _hash(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, start + i) for i in range(length)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per item and window of it: item_id, length, words."""
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"), words_of(F.col("text").cast("string")).alias("w")
    ).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    return items.select(
        "item_id",
        length.alias("length"),
        "w",
        F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"),
    ).select("item_id", "length", F.slice("w", F.col("at"), F.col("length")).alias("words"))


def _scan(rows: DataFrame, part: DataFrame, lengths: list[int], marks: bool) -> DataFrame:
    """Hit windows of one broadcast block; with ``marks`` also one row per document at position -1."""
    table = F.broadcast(
        part.select(
            F.col("length").alias("t_length"),
            F.col("words").alias("t_words"),
            _hash(F.col("words"), F.lit(0), max(lengths)).alias("t_hash"),  # words past a window's end are null: not hashed
            "window",
        )
    )
    last = F.size("w") - min(lengths)
    if marks:
        at = rows.withColumn("at", F.explode(F.sequence(F.lit(-1), F.greatest(last, F.lit(-1)))))
    else:
        at = rows.filter(last >= 0).withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    if len(lengths) == 1:
        tried = at.select("*", F.lit(lengths[0]).alias("length"), _hash(F.col("w"), F.col("at"), lengths[0]).alias("hash"))
    else:
        every = [F.struct(F.lit(k).alias("length"), _hash(F.col("w"), F.col("at"), k).alias("hash")) for k in lengths]
        tried = at.select("*", F.inline(F.array(*every)))
    same = (
        (F.col("hash") == F.col("t_hash"))
        & (F.col("length") == F.col("t_length"))
        & (F.col("at") >= 0)
        & (F.slice("w", F.greatest("at", F.lit(0)) + 1, F.col("length")) == F.col("t_words"))
    )
    joined = tried.join(table, same, "left" if marks else "inner")
    if marks:
        joined = joined.filter((F.col("at") == -1) | F.col("window").isNotNull())
    return joined.select("row", "doc_id", F.size("w").alias("n_words"), "at", "length", "window")


def _text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document: row, doc_id, n_words, hits (position and length of each hit window), items.

    ``row`` tells rows apart; its values have no meaning beyond this result.
    """
    return _scanned(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, window, block)


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``scan`` with a ``doc_id`` of any type."""
    occurrences = stored(item_windows(benchmark, window), "op6-windows")
    distinct = occurrences.groupBy("length", "words").agg(F.collect_set("item_id").alias("items"))
    distinct = stored(distinct.withColumn("window", F.sha2(F.array_join("words", " "), 256)), "op6-distinct")
    lengths = sorted(r[0] for r in distinct.select("length").distinct().collect()) or [window]  # at most ``window``
    blocks = max(1, -(-distinct.count() // block))
    rows = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        words_of(F.col("text").cast("string")).alias("w"),
    )
    of_block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    found = [_scan(rows, distinct.filter(of_block == b), lengths, b == 0) for b in range(blocks)]
    per_row = (
        reduce(DataFrame.unionByName, found)
        .groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").cast("bigint").alias("n_words"),
            F.collect_set(F.when(F.col("window").isNotNull(), F.struct("at", "length"))).alias("hits"),
            F.collect_set("window").alias("windows"),
        )
    )
    per_row = stored(per_row, "op6-rows")
    items = (
        per_row.select("row", F.explode("windows").alias("window"))
        .join(distinct.select("window", F.explode("items").alias("item_id")), "window")
        .groupBy("row")
        .agg(F.collect_set("item_id").alias("items"))
    )
    none = F.array().cast("array<bigint>")
    return per_row.drop("windows").join(items, "row", "left").withColumn("items", F.coalesce("items", none))


def _hit_words(hits: Column) -> Column:
    """Positions of all words inside hit windows."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1))))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of ``scan``'s hits, and a checksum of the items."""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(_hit_words(F.col("hits"))).cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _hit_texts(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``scan`` by the digest of a row's text in place of its ``doc_id``: what is hit depends on the text alone."""
    found = _scanned(docs.select(_text_key(F.col("text")).alias("doc_id"), "text"), benchmark, window)
    return found.filter(F.size("hits") > 0).withColumnRenamed("doc_id", "__dirty")


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that no window hits; each row goes or stays by its own text."""
    dirty = lookup(_hit_texts(docs, benchmark, window).select("__dirty").distinct())
    return docs.join(dirty, _text_key(docs["text"]) == dirty["__dirty"], "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id`` and ``text`` of every document, without the words inside hit windows and what stands before them."""
    hit = _hit_texts(docs, benchmark, window).groupBy("__dirty").agg(F.first(_hit_words(F.col("hits"))).alias("cut"))
    text = F.col("text").cast("string")
    parts = F.regexp_extract_all(text, F.lit(_SEGMENT), F.lit(0))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    gone = F.map_from_entries(F.transform("cut", lambda p: F.struct(p, F.lit(True))))
    kept = F.filter(parts, lambda part, i: F.try_element_at("gone", i).isNull())
    slim = docs.select("doc_id", "text", _text_key(docs["text"]).alias("__dirty"))
    return slim.join(hit.withColumn("gone", gone), "__dirty", "left").select(
        "doc_id", F.when(F.col("cut").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail)).alias("text")
    )


ORACLE = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_aggregate(w[p:p + least(len(w), 10) - 1], 'string_agg', ' ') AS s, least(len(w), 10) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (
  SELECT doc_id, k, p, list_aggregate(w[p:p + k - 1], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, lens WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, p, k, item_id FROM pos JOIN win USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit
      FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
