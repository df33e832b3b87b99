"""Token counts through a map-side lookup in two tiers.

Text is cut before each run of spaces. No piece of the vocabulary holds a space after another character (checked
when the model is loaded), so no merge crosses such a cut, and a text's count is the sum over its pre-tokens.

Tier one is a table of the most frequent pre-tokens and their token counts: every task summarises its own documents in a
bounded counter (rare entries are pruned), the short summaries are added up, and the best ``TABLE_SIZE`` are encoded
once and broadcast; the bound on entries and on their length bounds the broadcast to a few MB. It only saves time: no
count depends on it. Tier two is a bounded cache in each Python worker that encodes what the table lacks. Pre-token
occurrences are never shuffled, so a hot word or source costs nothing extra.

Rows: a null text counts as empty (0 tokens); a null ``doc_id`` stays null; repeated rows are counted each for
itself; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import doc_texts, map_batches, texts

TABLE_SIZE = 32_768
TASK_SUMMARY = 4_096
TASK_COUNTER = 131_072
KEY_LENGTH = 48
CACHED = 500_000

_RUNS = re.compile(" *[^ ]+| +")
_models: dict[str, object] = {}
_lengths: dict[str, Lengths] = {}


def model(path: str):
    """The processor of a model file, loaded once per worker and checked for the rule above."""
    if path not in _models:
        from sentencepiece import SentencePieceProcessor

        loaded = SentencePieceProcessor(model_file=path)
        crossing = re.compile("[^▁]▁")
        if any(crossing.search(loaded.id_to_piece(i)) for i in range(loaded.get_piece_size())):
            raise ValueError("pieces of this vocabulary cross spaces; texts cannot be cut there")
        _models[path] = loaded
    return _models[path]


def pretokens(text: str) -> list[str]:
    """Pre-tokens without their first space (the one the model puts before a text included)."""
    if not text:
        return []
    if "▁" in text:  # the model writes a space as this character
        text = text.replace("▁", " ")
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [run[1:] for run in _RUNS.findall(" " + text)]


class Lengths(dict):
    """Token counts by pre-token: the broadcast table first, the worker's own cache for the rest."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.path, self.table = path, table

    def __missing__(self, pretoken: str) -> int:
        # A lone space is a token of its own; the model would add its leading space to nothing.
        n = len(model(self.path).encode(pretoken)) if pretoken else 1
        if len(pretoken) <= 4 * KEY_LENGTH:
            if len(self) >= CACHED + len(self.table):
                self.clear()
                self.update(self.table)
            self[pretoken] = n
        return n


def worker_lengths(path: str, run: str, table) -> Lengths:
    """The worker's lookup for the table of a run; it lives on from task to task."""
    if run not in _lengths:
        _lengths.clear()
        _lengths[run] = Lengths(path, table.value)
    return _lengths[run]


def frequent(docs: DataFrame, path: str, size: int = TABLE_SIZE) -> dict[str, int]:
    """The table of frequent pre-tokens of all documents with their token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in texts(batch):
                counts.update(pretokens(text))
                if len(counts) > 2 * TASK_COUNTER:
                    counts = Counter(dict(counts.most_common(TASK_COUNTER)))
        best = [(k, n) for k, n in counts.most_common(TASK_SUMMARY) if len(k) <= KEY_LENGTH]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*best, strict=True)], names=["pretoken", "n"])

    found = (
        map_batches(doc_texts(docs), run, "pretoken string, n bigint")
        .groupBy("pretoken")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "pretoken")
        .limit(size)
        .collect()
    )
    lengths = Lengths(path, {})
    return {r["pretoken"]: lengths[r["pretoken"]] for r in found}


def count(docs: DataFrame, path: str, limit: int = 4096, size: int = TABLE_SIZE) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed ``limit``."""
    name = uuid.uuid4().hex
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_lengths(path, name, table)
        for batch in batches:
            counts = [sum(map(lengths.__getitem__, pretokens(text))) for text in texts(batch)]
            size = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size.cast(pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    counted = map_batches(doc_texts(docs), run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
