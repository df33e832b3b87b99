"""Repair of conversation structure: cheapest edits by Four-Russians block tables.

The initials of a repaired conversation's roles read ``(s?(ua)+)?``. Edits of rows are K (keep), R (another role: user or assistant), D
(delete) and I (an empty turn of user or assistant). The cost of the rest of a conversation is a vector over four states: nothing
yet, after s, after u, after a. Inserting turns leads from any state to an accepting one, so the vector without its minimum takes
few values; all of them, and what every block of ``BLOCK`` symbols makes of them, are computed once in tables. A conversation is
read from its end, a block a lookup. For the trace, blocks are expanded backward into their single vectors; from the front on, the ASCII-least
letter among all cheapest edits is taken. Every letter leads to one state, so that is the least of all cheapest strings.

No conversation is held by a task: rows are sorted by range (conversation, turn) and cut into chunks of at most ``CHUNK`` rows. What a
chunk makes of each vector, and of each state, is a small function; conversations of one chunk need none, and those of several
compose them, 1 entry for up to ``CHUNK`` rows. Only ``digest`` builds whole conversations, as its columns ask for: the audit string (a letter a row), and
one SHA-256 over all its lines, which cannot be split and is streamed through one task a conversation, in order.

Rows: nulls of all columns read as one space, but rows without ``conv_id`` are one conversation with a null id, and null turns come first;
rows that share conversation and turn are ordered by the SHA-256 of role and text; repeated rows count each for itself, so later ones are
duplicates; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import map_batches, stored

DROP, EMPTY, UNSTOPPED, TWICE, AS_USER = range(5)
FAULTS = 20
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
BLOCK = 4
CHUNK = 4096  # a divisor of 2^33, so that no chunk spans two sorted partitions
SPACES = " \t\n\x0b\x0c\r"

# Symbols: initial s, u, a or another, by kind: fine, truncated, must go (blank or duplicate).
INITIALS = "sua"
FINE, CUT_OFF, GONE = range(3)
KINDS = 3
SYMBOLS = (len(INITIALS) + 1) * KINDS
FIRST_SYMBOL = ord("a")
# What u or a, whichever is due, is in each state, and where it leads.
_DUE = "uuau"
_NEXT = (2, 2, 3, 2)
_ACCEPTING = (0, 3)


def _kept(state: int, initial: int) -> int | None:
    """The state after a kept row, or None where its initial is not due."""
    if initial == 0:
        return 1 if state == 0 else None
    return _NEXT[state] if initial < 3 and INITIALS[initial] == _DUE[state] else None


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in costs:
        costs = [min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _before(rest: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cheapest costs from each state in front of a row, given those behind it."""
    initial, kind = divmod(symbol, KINDS)
    costs = []
    for q in range(4):
        options = [DELETE + rest[q]]
        if kind != GONE:
            extra = TRUNCATED if kind == CUT_OFF else 0
            options.append(REROLE + extra + rest[_NEXT[q]])
            if (to := _kept(q, initial)) is not None:
                options.append(extra + rest[to])
        costs.append(min(options))
    return _with_inserts(costs)


@dataclass(frozen=True)
class Tables:
    """Normalised vectors, and what single symbols and blocks of symbols make of them (number of the vector, cost added)."""

    values: np.ndarray
    step: np.ndarray  # symbol, vector
    added: np.ndarray
    block: np.ndarray  # block, vector
    block_added: np.ndarray
    last: int  # the vector behind the last row


@lru_cache(1)
def tables() -> Tables:
    end = _with_inserts([0 if q in _ACCEPTING else 1 << 20 for q in range(4)])
    known = {end: 0}
    queue = [end]
    rows = []
    for vector in queue:
        made = []
        for symbol in range(SYMBOLS):
            costs = _before(vector, symbol)
            least = min(costs)
            normal = tuple(c - least for c in costs)
            if normal not in known:
                known[normal] = len(known)
                queue.append(normal)
            made.append((known[normal], least))
        rows.append(made)
    both = np.array(rows, np.int64)  # vector, symbol, (number, added)
    step, added = both[:, :, 0].T.copy(), both[:, :, 1].T.copy()
    block, block_added = step, added
    for _ in range(BLOCK - 1):  # one more symbol in front
        block_added = (block_added[None] + added[:, block]).reshape(-1, len(queue)) if block.ndim == 2 else block_added
        block = step[:, block].reshape(-1, len(queue))
    return Tables(np.array(queue, np.int64), step, added, block, block_added, 0)


def _codes(symbols: str) -> np.ndarray:
    return np.frombuffer(symbols.encode(), np.uint8).astype(np.int64) - FIRST_SYMBOL


def _blocks(codes: np.ndarray) -> np.ndarray:
    """Numbers of the whole blocks from the front on; the first symbol counts most."""
    whole = codes[: len(codes) // BLOCK * BLOCK].reshape(-1, BLOCK)
    return whole @ (SYMBOLS ** np.arange(BLOCK)[::-1])


def summary(symbols: str) -> np.ndarray:
    """The vector in front of the symbols, for each vector behind them."""
    t, codes = tables(), _codes(symbols)
    at = np.arange(len(t.values))
    for code in codes[len(codes) // BLOCK * BLOCK :][::-1]:
        at = t.step[code][at]
    for number in _blocks(codes)[::-1]:
        at = t.block[number][at]
    return at


@lru_cache(1 << 16)
def _letters(behind: int, symbol: int, state: int) -> tuple[str, str, int]:
    """The ASCII-least cheapest letters up to and with one row, the roles they set (- for none), and the state they lead to."""
    t = tables()
    rest, here = t.values[behind].tolist(), t.values[t.step[symbol, behind]].tolist()
    plus = int(t.added[symbol, behind])
    initial, kind = divmod(symbol, KINDS)
    extra = TRUNCATED if kind == CUT_OFF else 0
    letters = roles = ""
    while True:
        cost = here[state]
        if DELETE + rest[state] == cost + plus:
            return letters + "D", roles + "-", state
        if INSERT + here[_NEXT[state]] == cost:
            letters, roles, state = letters + "I", roles + _DUE[state], _NEXT[state]
            continue
        to = None if kind == GONE else _kept(state, initial)
        if to is not None and extra + rest[to] == cost + plus:
            return letters + "K", roles + "-", to
        return letters + "R", roles + _DUE[state], _NEXT[state]


def _last_letters(state: int) -> tuple[str, str]:
    """The turns inserted behind the last row."""
    letters = roles = ""
    while state not in _ACCEPTING:
        letters, roles, state = letters + "I", roles + _DUE[state], _NEXT[state]
    return letters, roles


@lru_cache(1 << 16)
def _expanded(codes: bytes, behind: int, state: int) -> tuple[str, str, int]:
    """Letters and roles of a block: its vectors are found backward, its letters from the front on."""
    t = tables()
    vectors = [behind]
    for code in codes[:0:-1]:
        vectors.append(int(t.step[code, vectors[-1]]))
    letters, roles = [], []
    for code, vector in zip(codes, vectors[::-1], strict=True):
        more, set_, state = _letters(vector, code, state)
        letters.append(more)
        roles.append(set_)
    return "".join(letters), "".join(roles), state


def trace(symbols: str, behind: int, state: int, last: bool) -> tuple[str, str, int, int]:
    """Letters, the roles they set, the state behind the symbols, and the cost; ``last``: no row follows."""
    t, codes = tables(), _codes(symbols)
    numbers = _blocks(codes).tolist()
    rest = codes[len(numbers) * BLOCK :]
    cost, vector = 0, behind
    for code in rest[::-1]:
        cost, vector = cost + int(t.added[code, vector]), int(t.step[code, vector])
    ends = []
    for number in numbers[::-1]:
        ends.append(vector)
        cost, vector = cost + int(t.block_added[number, vector]), int(t.block[number, vector])
    cost += int(t.values[vector, state])
    letters, roles = [], []
    raw = codes.astype(np.uint8).tobytes()
    parts = [(raw[k * BLOCK : (k + 1) * BLOCK], v) for k, v in enumerate(ends[::-1])]
    if len(rest):
        parts.append((raw[len(numbers) * BLOCK :], behind))
    for part, vector in parts:
        more, set_, state = _expanded(part, vector, state)
        letters.append(more)
        roles.append(set_)
    if last:
        more, set_ = _last_letters(state)
        letters.append(more)
        roles.append(set_)
    else:
        cost -= int(t.values[behind, state])
    return "".join(letters), "".join(roles), state, cost


def illegal_pairs(symbols: str) -> int:
    """Adjacent rows whose initials are not su, ua or au."""
    initials = _codes(symbols) // KINDS
    a, b = initials[:-1], initials[1:]
    return int((~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))).sum())


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with nulls as one space: conv (a key), conv_id, turn, role, text."""
    text_of = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text_of.alias("text"),
    )
    id_, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    rows = rows.withColumn("conv", id_).withColumn("fault", F.pmod(F.crc32(F.concat(id_, F.lit(":"), turn)), F.lit(FAULTS)))
    fault = F.col("fault")
    text = F.when(fault == EMPTY, "").when(fault == UNSTOPPED, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fault == AS_USER, "user").otherwise(F.col("role"))
    rows = rows.filter(fault != DROP).select("conv", "conv_id", "turn", role.alias("role"), text.alias("text"), "fault")
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("fault") == TWICE, 1).otherwise(0)))
    return rows.select("conv", "conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with ``at``, their place in the order of conversation and turn, and ``seen``, a digest of conversation, role and text."""
    parts = [F.col("conv"), F.lit("\n"), F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")]
    rows = rows.withColumn("seen", F.unhex(F.sha2(F.concat(*parts), 256))).withColumn("input", F.monotonically_increasing_id())
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("seen"), F.col("input")]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("input")
    return stored(rows.withColumn("at", F.monotonically_increasing_id()), "op11-ordered")


def marked(rows: DataFrame) -> DataFrame:
    """conv, at, turn, kind of fault and initial of every ordered row."""
    first = rows.groupBy("seen").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select("seen", "first")
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    found = rows.select("conv", "at", "turn", "seen", end.alias("end"), F.substring("role", 1, 1).alias("initial")).join(first, "seen", "left")
    blank, duplicate = F.col("end") == "", F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    truncated = ~blank & ~duplicate & ~F.col("end").isin(".", "!", "?")
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.col("initial")), F.lit(0)) - 1, F.lit(len(INITIALS)))
    initial = F.when(F.col("initial") == "", len(INITIALS)).otherwise(initial)
    kind = F.when(blank | duplicate, GONE).when(truncated, CUT_OFF).otherwise(FINE)
    return found.select(
        "conv", "at", "turn", blank.alias("blank"), (duplicate & ~blank).alias("duplicate"), truncated.alias("truncated"),
        F.char(F.lit(FIRST_SYMBOL) + initial * KINDS + kind).alias("symbol"),
    )


def chunks(marks: DataFrame) -> DataFrame:
    """conv, chunk, symbols and places of at most ``CHUNK`` rows of a conversation."""
    rows = marks.groupBy("conv", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("rows"))
    return rows.select("conv", "chunk", F.array_join("rows.symbol", "").alias("symbols"), F.col("rows.at").alias("places"))


def _several(parts: DataFrame) -> DataFrame:
    """conv, chunk, vector behind, state in front, and whether it is the last, for the chunks of conversations of several chunks."""

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(s).astype("<i4").tobytes() for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(found, pa.binary())], ["conv", "chunk", "of"])

    def from_the_end(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        behind, vector = [], tables().last
        for of in rows["of"][::-1]:
            behind.append(vector)
            vector = int(np.frombuffer(of, "<i4")[vector])
        last = np.arange(len(rows)) == len(rows) - 1
        return pd.DataFrame({"conv": rows["conv"], "chunk": rows["chunk"], "behind": behind[::-1], "last": last})

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                bytes(trace(s, v, q, False)[2] for q in range(4))
                for s, v in zip(batch.column("symbols").to_pylist(), batch.column("behind").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "chunk", "behind", "last")), pa.array(found)], ["conv", "chunk", "behind", "last", "of"])

    def from_the_front(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        fronts, state = [], 0
        for of in rows["of"]:
            fronts.append(state)
            state = of[state]
        return rows[["conv", "chunk", "behind", "last"]].assign(state=fronts)

    made = map_batches(parts.select("conv", "chunk", "symbols"), functions, "conv string, chunk bigint, of binary")
    behind = made.groupBy("conv").applyInPandas(from_the_end, "conv string, chunk bigint, behind int, last boolean")
    known = parts.select("conv", "chunk", "symbols").join(behind, ["conv", "chunk"])
    known = map_batches(known, states, "conv string, chunk bigint, behind int, last boolean, of binary")
    return known.groupBy("conv").applyInPandas(from_the_front, "conv string, chunk bigint, behind int, last boolean, state int")


def edits(parts: DataFrame) -> DataFrame:
    """conv, chunk, first and last symbol, illegal pairs, cost, audit, roles and places of each chunk's edits."""
    several = parts.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    several = stored(several, "op11-several")
    of_several = stored(parts.join(several, "conv"), "op11-parts")
    facts = stored(_several(of_several), "op11-facts")
    single = parts.join(several, "conv", "left_anti").select(
        "*", F.lit(tables().last).cast("int").alias("behind"), F.lit(True).alias("last"), F.lit(0).cast("int").alias("state")
    )
    every = single.unionByName(of_several.join(facts, ["conv", "chunk"]))
    names = ["conv", "chunk", "first", "final", "illegal", "cost", "audit", "roles", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            inputs = (batch.column(c).to_pylist() for c in ("symbols", "places", "behind", "state", "last"))
            for symbols, places, behind, state, last in zip(*inputs, strict=True):
                audit, roles, _, cost = trace(symbols, behind, state, last)
                of_row = iter(places)
                rows.append(
                    (symbols[0], symbols[-1], illegal_pairs(symbols), cost, audit, roles, [None if x == "I" else next(of_row) for x in audit])
                )
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), *columns], names)

    schema = "conv string, chunk bigint, first string, final string, illegal bigint, cost bigint, audit string, roles string, places array<bigint>"
    every = every.select("conv", "chunk", "symbols", "places", "behind", "state", "last")
    return stored(map_batches(every, run, schema), "op11-edits")


def _letters_of(column: str) -> Column:
    return F.regexp_extract_all(column, F.lit("."), F.lit(0))


def repaired(rows: DataFrame, made: DataFrame) -> DataFrame:
    """conv, chunk, k (order within it), edit, role and text of every turn that is left, from ordered rows and ``edits``."""
    letters = made.select(
        "conv", "chunk",
        F.posexplode(F.arrays_zip(_letters_of("audit").alias("edit"), _letters_of("roles").alias("new"), F.col("places").alias("at"))).alias("k", "e"),
    ).select("conv", "chunk", "k", "e.*").filter("edit <> 'D'")
    role = F.when(F.col("new") == "u", "user").when(F.col("new") == "a", "assistant")
    letters = letters.select("conv", "chunk", "k", "edit", role.alias("new_role"), "at")
    kept = letters.filter("edit <> 'I'").join(rows.select("at", "role", "text"), "at")
    kept = kept.select("conv", "chunk", "k", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    new = letters.filter("edit = 'I'").select("conv", "chunk", "k", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(new)


def _hashes(turns: DataFrame) -> DataFrame:
    """The SHA-256 of each conversation's lines, streamed in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if conv != now:
                    if hashed is not None:
                        done.append((now, hashed.hexdigest()))
                    now, hashed = conv, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["conv", "hash"])
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([hashed.hexdigest()])], ["conv", "hash"])

    lines = turns.select("conv", "chunk", "k", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", "chunk", "k").select("conv", "line")
    return map_batches(lines, run, "conv string, hash string")


def repair(conversations: DataFrame) -> DataFrame:
    """Damages the conversations by the rule of their rows' keys, repairs them, and returns one row of facts for each."""
    keys = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    keys = keys.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    rows = ordered(damaged(conversations))
    marks = stored(marked(rows), "op11-marks")
    made = edits(stored(chunks(marks), "op11-chunks"))
    count = [F.sum(F.col(c).cast("bigint")).alias(c) for c in ("blank", "duplicate", "truncated")]
    spread = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    facts = marks.groupBy("conv").agg(F.coalesce(spread, F.lit(0)).cast("bigint").alias("gaps"), *count)
    # Chunks meet as one entry each: their audits, and the pairs of initials at their seams.
    seams = F.array_sort(F.collect_list(F.struct("chunk", "first", "final", "audit")))
    whole = made.groupBy("conv").agg(seams.alias("of"), F.sum("illegal").alias("inner"), F.sum("cost").alias("cost"))
    initial = lambda c: F.floor((F.ascii(c) - FIRST_SYMBOL) / KINDS)
    pairs = F.zip_with(
        F.slice("of", 1, F.size("of") - 1), F.slice("of", 2, F.size("of") - 1), lambda a, b: F.array(initial(a["final"]), initial(b["first"]))
    )
    fine = [F.array(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")) for a, b in ((0, 1), (1, 2), (2, 1))]
    bad = F.size(F.filter(pairs, lambda p: ~((p == fine[0]) | (p == fine[1]) | (p == fine[2]))))
    whole = whole.select("conv", (F.col("inner") + bad).alias("illegal"), "cost", F.array_join("of.audit", "").alias("audit"))
    hashes = _hashes(repaired(rows, made))
    none = hashlib.sha256().hexdigest()
    found = keys.join(facts, "conv", "left").join(whole, "conv", "left").join(hashes, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("hash", F.lit(none)).alias("repaired_sha256"))
