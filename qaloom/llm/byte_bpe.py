"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding by kept offsets.

Texts are cut without a regular expression. Each code point becomes a class (letter, number, other, space, other white space), and with
its successors a symbol, such as "apostrophe before one letter of a contraction" or "space before a word". A symbol is a
function from the state before it to the state after it; these functions and all their compositions are a small monoid, so a
function is a number and a composition one lookup. Composition is associative: a group of texts is laid out as many short columns
that are scanned side by side, then the columns' totals are scanned, and state and symbol say at every code point whether a piece begins.

Pieces are slices of the UTF-8 bytes. A piece is a token as it stands, or its bytes are merged pair by pair, the
least rank first and the leftmost of equals: new short pieces of a group side by side in arrays, long ones by a heap. The ids of pieces are
cached in two generations, but for the longest. For every token the byte at which it ends is kept, so any run of tokens can be decoded alone and matched to its place.

The classes come from the tokenizer library itself (all code points once, on the driver; broadcast, 1.1 MB), because Unicode tables of different
versions disagree on thousands of letters. Both directions are maps inside the tasks that read the rows: no shuffle.

Rows: a null text is empty and has no ids; bytes that are no UTF-8 read as U+FFFD; a null ``doc_id`` stays null; repeated rows are encoded
each for itself; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
from collections import ChainMap
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import doc_texts, map_batches
from qaloom.llm.packing import Cache

LETTER, NUMBER, OTHER, SPACE, WHITE, END = range(6)
GROUP_CHARS = 1 << 19  # characters scanned at once; a longer text is a group of its own
CACHED = 120_000  # entries of one generation of the cache
CACHED_BYTES = 64
HEAPED_BYTES = 32  # longer pieces are merged by a heap
_NO_KEY = np.uint64((1 << 64) - 1)

# Symbols, and states after a symbol.
_LETTER, _NUMBER, _OTHER, _CUT_1, _CUT_2, _WHITE, _LAST_SPACE, _LAST_WHITE, _END = range(9)
_FRESH, _LETTERS, _NUMBERS, _OTHERS, _WHITES, _JOINED, _ONE_LEFT, _TWO_LEFT = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece begins at it."""
    if symbol == _END:
        return _FRESH, True
    if symbol == _LAST_SPACE:
        return _JOINED, True
    if symbol == _LAST_WHITE:
        return _FRESH, True
    if symbol == _WHITE:
        return _WHITES, state != _WHITES
    if symbol == _LETTER:
        if state in (_ONE_LEFT, _TWO_LEFT):
            return (_FRESH if state == _ONE_LEFT else _ONE_LEFT), False
        return _LETTERS, state not in (_LETTERS, _JOINED)
    if symbol == _NUMBER:
        return _NUMBERS, state not in (_NUMBERS, _JOINED)
    if state in (_OTHERS, _JOINED):
        return _OTHERS, False
    return {_OTHER: _OTHERS, _CUT_1: _ONE_LEFT, _CUT_2: _TWO_LEFT}[symbol], True


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Functions of the symbols, the product table, the state each function makes of each state, and where pieces begin."""
    states, symbols = range(8), range(9)
    of_symbol = [tuple(_step(s, x)[0] for s in states) for x in symbols]
    known = {f: k for k, f in enumerate(dict.fromkeys(of_symbol))}
    queue = list(known)
    for f in queue:
        for g in of_symbol:
            made = tuple(g[s] for s in f)
            if made not in known:
                known[made] = len(known)
                queue.append(made)
    every = list(known)
    product = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint16)
    begins = np.array([[_step(s, x)[1] for x in symbols] for s in states])
    return np.array([known[f] for f in of_symbol], np.uint16), product, np.array(every, np.uint8), begins


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, from the fresh state on, by a scan of transition functions."""
    of_symbol, product, apply, _ = _monoid()
    n = len(symbols)
    width = max(1, int(np.sqrt(n)))
    columns = -(-n // width)
    grid = np.full(columns * width, _END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(of_symbol[grid].reshape(columns, width).T)  # row k: the k-th symbol of every column
    for k in range(1, width):
        grid[k] = product[grid[k - 1], grid[k]]
    start = np.zeros(columns, np.uint8)
    for k in range(1, columns):
        start[k] = apply[grid[-1, k - 1], start[k - 1]]
    before = np.empty((columns, width), np.uint8)
    before[:, 0] = start
    before[:, 1:] = apply[grid[:-1], start].T
    return before.reshape(-1)[:n]


def _symbols(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols from code points and their classes; texts end in the class ``END``."""
    after = np.append(classes[1:], np.uint8(END))
    white = classes >= SPACE
    solid_next = after <= OTHER
    symbols = classes.copy()
    symbols[white] = _WHITE
    symbols[(classes == SPACE) & solid_next] = _LAST_SPACE
    symbols[(classes == WHITE) & solid_next] = _LAST_WHITE
    symbols[classes == END] = _END
    quotes = np.flatnonzero((codes == ord("'")) & (after == LETTER))
    if len(quotes):
        # The contractions 's 't 'm 'd 're 've 'll.
        one = codes[quotes + 1]
        two = codes[np.minimum(quotes + 2, len(codes) - 1)]
        two = np.where(classes[np.minimum(quotes + 2, len(codes) - 1)] == LETTER, two, 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbols[quotes[single]] = _CUT_1
        symbols[quotes[double]] = _CUT_2
    return symbols


def pieces(texts: list[str], class_of: np.ndarray) -> list[list[bytes]]:
    """The pieces of each text, as UTF-8."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    classes = class_of[codes]
    classes[ends] = END
    symbols = _symbols(codes, classes)
    begins = _monoid()[3][_states_before(symbols), symbols]
    at = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64))
    first = np.flatnonzero(begins)
    starts = np.append(0, at)[first]
    data = joined.encode()
    slices = list(map(data.__getitem__, map(slice, starts.tolist(), [*starts[1:].tolist(), len(data)])))
    # The end of a text is a piece of its own here, and is left out.
    last = np.searchsorted(first, ends).tolist()
    return [slices[a:b] for a, b in zip([0, *(k + 1 for k in last)], last, strict=False)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def library_classes() -> np.ndarray:
    """The class of every code point, as the tokenizer library tells letters, numbers and white space apart."""
    import tiktoken

    every = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = every.tobytes().decode("utf-32-le")
    one_byte = {bytes([b]): b for b in range(256)}
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        probe = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=one_byte, special_tokens={})
        found = bytes(probe.encode_ordinary(text)).decode()
        classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    classes[ord(" ")] = SPACE
    return classes


class PairTable:
    """The rank of each pair of tokens that makes a token: open addressing, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int], none: int):
        pairs = [
            (left, right, rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
        ]
        left, right, rank = np.array(pairs, np.uint64).reshape(-1, 3).T
        self.none = none
        self.bits = max(4, int(3 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, _NO_KEY)
        self.values = np.full(1 << self.bits, none, np.int32)
        keys, slots = left << np.uint64(32) | right, self._slots(left << np.uint64(32) | right)
        while len(keys):
            free, first = np.unique(slots, return_index=True)
            first = first[self.keys[free] == _NO_KEY]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], rank[first]
            left_over = np.ones(len(keys), bool)
            left_over[first] = False
            keys, rank, slots = keys[left_over], rank[left_over], self._next(slots[left_over])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slots: np.ndarray) -> np.ndarray:
        return (slots + 1) & ((1 << self.bits) - 1)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = self._slots(keys)
        found = self.values[slots]
        other = np.flatnonzero(self.keys[slots] != keys)  # free, or taken by another pair
        while len(other):
            there = self.keys[slots[other]]
            found[other[there == _NO_KEY]] = self.none
            taken = (there != _NO_KEY) & (there != keys[other])
            same = other[there == keys[other]]
            found[same] = self.values[slots[same]]
            other = other[taken]
            slots[other] = self._next(slots[other])
        return found


class Ranks:
    """Merges the bytes of pieces by rank; the ids (little-endian unsigned 32 bit) of short pieces are cached."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.none = len(self.bytes_of)
        self.pairs = PairTable(ranks, self.none)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.ids = Cache()

    def _merged(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of one length, side by side: in each step every piece merges its leftmost pair of least rank."""
        n = len(pieces)
        tokens = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)].reshape(n, width)
        if (tokens < 0).any():
            raise KeyError("a byte without a rank")
        costs = np.full((n, width), self.none, np.int32)  # of the pair that starts here
        costs[:, :-1] = self.pairs.of(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, -1)
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = after - 2
        alive = np.ones((n, width), bool)
        row = np.arange(n)
        while True:
            at = costs[row].argmin(axis=1)
            best = costs[row, at]
            open_ = best < self.none
            row, at, best = row[open_], at[open_], best[open_]
            if not len(row):
                break
            gone = after[row, at]
            then = after[row, gone]
            tokens[row, at], alive[row, gone], costs[row, gone] = best, False, self.none
            after[row, at] = then
            inner = then < width
            r, a, t = row[inner], at[inner], then[inner]
            before[r, t] = a
            costs[row, at] = self.none
            costs[r, a] = self.pairs.of(best[inner], tokens[r, t])
            left = at > 0
            r, a = row[left], at[left]
            b = before[r, a]
            costs[r, b] = self.pairs.of(tokens[r, b], best[left])
        flat = tokens[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merged_by_heap(self, piece: bytes) -> list[bytes]:
        """The same merges for long pieces: a heap of (rank, place), where outdated entries are passed over."""
        n = len(piece)
        rank = self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        before = list(range(-1, n - 1))

        def cost(k: int) -> int | None:
            after = end[k]
            return rank(piece[k : end[after]]) if after < n else None

        heap = [(c, k, k + 2) for k in range(n - 1) if (c := cost(k)) is not None]
        heapify(heap)
        while heap:
            _, k, stop = heappop(heap)
            if not end[k] or end[k] >= n or end[end[k]] != stop:
                continue
            middle = end[k]
            end[k], end[middle] = stop, 0
            if stop < n:
                before[stop] = k
            for place in (k, before[k]):
                if place >= 0 and (c := cost(place)) is not None:
                    heappush(heap, (c, place, end[end[place]]))
        return [piece[k : end[k]] for k in range(n) if end[k]]

    def encode_pieces(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces. A byte that has no rank is an error."""
        found, by_length = {}, {}
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                found[piece] = whole.to_bytes(4, "little")
            elif len(piece) > HEAPED_BYTES:
                found[piece] = np.array([self.ranks[p] for p in self._merged_by_heap(piece)], "<u4").tobytes()
            else:
                by_length.setdefault(len(piece), []).append(piece)
        for width, same in by_length.items():
            found.update(zip(same, self._merged(same, width), strict=True))
        return found

    def encode(self, texts: list[str], class_of: np.ndarray) -> list[bytes]:
        """Ids of each text of a group."""
        cut = pieces(texts, class_of)
        self.ids.turn(CACHED)
        known, old = self.ids, self.ids.old
        new = set().union(*cut).difference(known)
        again = new.intersection(old)
        known.update((p, old[p]) for p in again)
        new -= again
        made = self.encode_pieces(new)
        long = {p: made.pop(p) for p in new if len(p) > CACHED_BYTES}
        known.update(made)
        one = ChainMap(known, long).__getitem__ if long else known.__getitem__
        return [b"".join(map(one, p)) for p in cut]

    def decode(self, ids: bytes) -> list[bytes]:
        """Bytes of each token."""
        return list(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ranks: dict[str, Ranks] = {}


def _worker_ranks(path: str) -> Ranks:
    """The worker's own tables and caches for a rank file; they live on from task to task."""
    if path not in _ranks:
        _ranks[path] = Ranks(read_ranks(path))
    return _ranks[path]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in groups of some ``GROUP_CHARS`` characters, with the row each group starts at."""
    start, group, size = 0, [], 0
    column = batch.column("text").cast(pa.binary())
    for k in range(batch.num_rows):
        text = (column[k].as_py() or b"").decode("utf-8", "replace")
        group.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield start, group
            start, group, size = k + 1, [], 0
    if group:
        yield start, group


def encode(docs: DataFrame, ranks: str, decoded: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` and ``ends`` of every whole text, both as little-endian 32-bit numbers.

    ``ranks`` is the path of a rank file on every machine. ``ends`` holds, for each token, the byte of the text at which it ends. With
    ``decoded`` the column of that name follows: the bytes the ids stand for, made from the ids in the same pass.
    """
    class_of = docs.sparkSession.sparkContext.broadcast(library_classes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _worker_ranks(ranks)
        length = np.array([len(t) for t in merged.bytes_of], np.int64)
        for batch in batches:
            for start, group in _groups(batch):
                ids = merged.encode(group, class_of.value)
                ends = [np.cumsum(length[np.frombuffer(i, "<u4")]).astype("<u4").tobytes() for i in ids]
                columns = [batch.column("doc_id").slice(start, len(group)), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())]
                if decoded:
                    columns.append(pa.array([b"".join(merged.decode(i)) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "ends", "decoded"][: len(columns)])

    return map_batches(doc_texts(docs), run, "doc_id bigint, ids binary, ends binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of ``encoded`` with ``decoded``, the bytes of its tokens, and ``start``, the byte of the text at which they start.

    With the columns ``first`` and ``last`` only that run of tokens is decoded (from 0, ``last`` not included; null: from the first, to the
    last). A run that is cut inside a character gives the bytes it has.
    """
    slim = encoded.select(
        "doc_id", "ids", "ends",
        (F.col(first) if first else F.lit(None)).cast("bigint").alias("first"),
        (F.col(last) if last else F.lit(None)).cast("bigint").alias("last"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _worker_ranks(ranks)
        for batch in batches:
            decoded, starts = [], []
            for ids, ends, a, b in zip(*(batch.column(c).to_pylist() for c in ("ids", "ends", "first", "last")), strict=True):
                n = len(ids or b"") // 4
                a, b = min(n, max(0, a or 0)), n if b is None else min(n, max(0, b))
                decoded.append(b"".join(merged.decode((ids or b"")[4 * a : 4 * b])))
                starts.append(int.from_bytes(ends[4 * a - 4 : 4 * a], "little") if a else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(decoded, pa.binary()), pa.array(starts, pa.int64())],
                ["doc_id", "ids", "decoded", "start"],
            )

    return map_batches(slim, run, "doc_id bigint, ids binary, decoded binary, start bigint")


def digest(decoded: DataFrame) -> DataFrame:
    """Counts and checksums in place of ids and bytes."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
