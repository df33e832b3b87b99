"""Sequence packing as vector bin packing with the dot-product heuristic.

A document becomes token ids plus one end id. What exceeds a sequence is cut off in full pieces; the rest is
placed under three limits at once: tokens, segments, and loss-bearing tokens of a sequence. The next piece for an
open sequence is the one that fits and has the largest dot product of its (scaled) demand with the space that is left.
When nothing fits, a piece is cut to close the gap.

Tokenising and packing happen in the task that reads the documents: there is no shuffle, a hot source or group
of copies is no different from other rows, and a task holds at most ``WINDOW`` open pieces. A lost task is run
again and gives the same rows. Each task may end with one underfull sequence, so very many tiny input files cost padding.

Rows: a null text is empty and yields its end id alone; a null ``doc_id`` stays null; repeated rows are packed
each for itself; an empty table yields no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections import ChainMap
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import map_batches

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
END_ID = 1
WINDOW = 2048  # pieces a task holds open at once
CARRIED = 512  # pieces left open when a window is packed, so that the next one has a choice
LEAST_CUT = 16  # gaps of fewer tokens are padded instead of cutting a piece
CACHED = 300_000  # entries of one generation of a cache
CACHED_LENGTH = 96
GROUP_CHARS = 1 << 21

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint,"
    " loss_tokens bigint"
)
# Python splits at these, the tokenizer does not.
_UNEQUAL_SPACES = "\x1c\x1d\x1e\x1f"
# What needs Unicode normalisation in a chunk, or may be an added token; chunks without are plain.
_NOT_PLAIN = re.compile("[^\n\x21-\x7e\xa1-\xac\xae-\xff]|<\\|")
# No token has this id, and no bytes of ids look like it, as ids have zero upper bytes.
_CUT = b"\xff\xff\xff\xff"


class Cache(dict):
    """Two generations of ``CACHED`` entries, or another limit: what was used since the last change of generation survives it."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def turn(self, limit: int = CACHED) -> None:
        """Begins a new generation if this one is full; called between groups, so a group's own entries stay."""
        if len(self) > limit:
            self.old = dict(self)
            self.clear()


class ChunkIds(Cache):
    """Ids (little-endian unsigned 32 bit) of the text between white space.

    The tokenizer drops white space, so a text's ids are those of its chunks in a row. New chunks of a group of texts are
    cut into pre-tokens, as the tokenizer cuts them, and new pre-tokens are encoded in one call: the last id of a
    pre-token is a word end, and only that one. Chunks that are not plain are encoded whole.
    """

    # The tokenizer's rule for pre-tokens (and the line ends set between chunks), its mark of word ends.
    RULE = r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORD_END = "</w>"

    def __init__(self, path: str, entries: int = CACHED):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.entries = entries
        self.cut = regex.compile(self.RULE).findall
        self.tokenizer = Tokenizer.from_file(path)
        self.pretokens = Cache()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.WORD_END)]] = True

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_pretokens(self, pretokens: list[str]) -> dict[str, bytes]:
        if not pretokens:
            return {}
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(pretokens)], add_special_tokens=False)[0].ids, "<u4")
        after = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(after) != len(pretokens):
            raise ValueError("this tokenizer does not end each pre-token with a word end")
        line = ids.tobytes()
        return {t: line[a:b] for t, a, b in zip(pretokens, [0, *after], after, strict=False)}

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Keeps the ids of short chunks, and returns those of long ones, which are not kept."""
        long = {c: self.encode(c) for c in chunks if len(c) > CACHED_LENGTH}
        plain = [c for c in chunks if c not in long] if long else chunks
        own = {}
        if _NOT_PLAIN.search("\n".join(plain)):
            own = {c: self.encode(c) for c in plain if _NOT_PLAIN.search(c)}
            plain = [c for c in plain if c not in own]
        if plain:
            # One pass over all plain chunks, which hold no line end themselves.
            pretokens = self.cut("\n".join(plain).lower())
            cache, old = self.pretokens, self.pretokens.old
            known = {t: cache.get(t) or old.get(t) for t in set(pretokens)}
            known["\n"] = _CUT
            known |= self.encode_pretokens([t for t, ids in known.items() if ids is None])
            line = b"".join(map(known.__getitem__, pretokens))
            own.update(zip(plain, line.split(_CUT), strict=True))
            del known["\n"]
            cache.update(known)
        self.update(own)
        return long

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text of a group."""
        parts = [None if any(c in text for c in _UNEQUAL_SPACES) else text.split() for text in texts]
        chunks = set().union(*(p for p in parts if p))
        self.turn(self.entries)
        self.pretokens.turn(self.entries)
        new = list(filterfalse(self.__contains__, chunks))
        self.update((c, self.old[c]) for c in new if c in self.old)
        long = self.learn(list(filterfalse(self.__contains__, new)))
        one = ChainMap(self, long).__getitem__ if long else self.__getitem__
        return [self.encode(text) if p is None else b"".join(map(one, p)) for text, p in zip(texts, parts, strict=True)]


_chunks: dict[tuple[str, int], ChunkIds] = {}


def chunk_ids(path: str, entries: int = CACHED) -> ChunkIds:
    """The worker's own cache for a tokenizer file; it lives on from task to task."""
    if (path, entries) not in _chunks:
        _chunks[path, entries] = ChunkIds(path, entries)
    return _chunks[path, entries]


class Bins:
    """Packs pieces as they come; ``full`` gathers the rows of closed sequences."""

    def __init__(self, first_id: int, limits: tuple[int, int, int]):
        self.next_id = first_id
        self.limits = np.asarray(limits, float)
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens, prompt)
        self.rows: list[tuple] = []

    @staticmethod
    def loss(start: int, length: int, prompt: int) -> int:
        """Loss-bearing ids of a piece: those after the document's first ``prompt`` ids."""
        return max(0, start + length - max(start, prompt))

    def most(self, start: int, prompt: int, tokens: float, loss: float) -> int:
        """The longest piece from ``start`` under limits on tokens and loss-bearing tokens."""
        return int(min(tokens, max(0, prompt - start) + loss))

    def add(self, doc_id, ids: bytes, prompt: int) -> None:
        total, start = len(ids) // 4, 0
        while True:
            size = self.most(start, prompt, self.limits[0], self.limits[2])
            if total - start < size:
                break
            self.close([((doc_id, start, ids[4 * start : 4 * (start + size)], total, prompt), size)])
            start += size
        if start < total:
            self.open.append((doc_id, start, ids[4 * start :], total, prompt))

    def close(self, chosen: list[tuple[tuple, int]]) -> None:
        offset = 0
        for (doc_id, start, ids, total, prompt), size in chosen:
            loss = self.loss(start, size, prompt)
            self.rows.append((doc_id, start, size, ids[: 4 * size], total, self.next_id, offset, loss))
            offset += size
        self.next_id += 1

    def pack(self, keep: int) -> None:
        """Fills sequences until at most ``keep`` pieces are open."""
        pieces = self.open
        tokens = np.array([len(p[2]) // 4 for p in pieces], float)
        loss = np.array([self.loss(p[1], len(p[2]) // 4, p[4]) for p in pieces], float)
        waiting = np.ones(len(pieces), bool)
        left = len(pieces)
        scale = 1 / self.limits**2
        while left > keep:
            (space, segments, bearing), chosen = self.limits.tolist(), []
            while left and segments >= 1 and space >= 1:
                # Each piece is one segment, which adds the same to all products. What is placed demands infinitely much.
                worth = tokens * (space * scale[0]) + loss * (bearing * scale[2])
                worth[(tokens > space) | (loss > bearing)] = -1.0
                k = int(worth.argmax())
                if worth[k] >= 0:
                    chosen.append((pieces[k], int(tokens[k])))
                    space, segments, bearing = space - float(tokens[k]), segments - 1, bearing - float(loss[k])
                    tokens[k] = np.inf
                    waiting[k] = False
                    left -= 1
                    continue
                if space < LEAST_CUT:
                    break
                k = int(np.where(waiting, tokens, -1.0).argmax())
                doc_id, start, ids, total, prompt = pieces[k]
                size = self.most(start, prompt, min(space, tokens[k] - 1), bearing)
                if size < 1:
                    break
                pieces[k] = (doc_id, start + size, ids[4 * size :], total, prompt)
                chosen.append(((doc_id, start, ids, total, prompt), size))
                space, segments, bearing = space - size, segments - 1, bearing - self.loss(start, size, prompt)
                rest = int(tokens[k]) - size
                tokens[k], loss[k] = rest, self.loss(start + size, rest, prompt)
            self.close(chosen)
        self.open = [p for p, w in zip(pieces, waiting, strict=True) if w]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _groups(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The rows of a batch in groups of some ``GROUP_CHARS`` characters."""
    rows, size = [], 0
    for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "prompt")), strict=True):
        rows.append(row)
        size += len(row[1] or "")
        if size >= GROUP_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    prompt_tokens: str | None = None,
    end_id: int = END_ID,
    cached: int = CACHED,
    kept: bool = True,
) -> DataFrame:
    """Pieces of all documents with their ids and their place in a sequence.

    ``tokenizer`` is the path of a tokenizer file with the rule of ``ChunkIds``. ``prompt_tokens`` names a column
    with the number of leading ids of a document that bear no loss (null: none). ``max_loss`` limits the others. ``cached``: entries of one
    generation of a worker's caches, which cost memory and save time; ``kept``: whether they outlive a task.
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    if min(limits) < 1:
        raise ValueError("limits must be at least 1")
    prompt = F.lit(0) if prompt_tokens is None else F.greatest(F.coalesce(F.col(prompt_tokens), F.lit(0)), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), prompt.cast("bigint").alias("prompt")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_ids(tokenizer, cached) if kept else ChunkIds(tokenizer, cached)
        end = np.asarray([end_id], "<u4").tobytes()
        bins = Bins(TaskContext.get().partitionId() << 40, limits)
        for batch in batches:
            for rows in _groups(batch):
                for (doc_id, _, n), ids in zip(rows, chunks.of([text or "" for _, text, _ in rows]), strict=True):
                    bins.add(doc_id, ids + end, n)
                    if len(bins.open) >= WINDOW:
                        bins.pack(CARRIED)
                    if len(bins.rows) >= 2000:
                        yield _batch(bins.rows)
                        bins.rows = []
        bins.pack(0)
        if bins.rows:
            yield _batch(bins.rows)

    return map_batches(rows, run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )
