"""Conversation repair against a plain dynamic programme over whole edit strings."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from qaloom.llm import queries, turn_repair

DUE = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLE = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost, letters and lines of the least edits; rows are (role, text, kind), kinds as in the operator."""

    def inserted(best):
        more = True
        while more:
            more = False
            for q, (cost, letters, lines) in list(best.items()):
                for x in set(DUE[q]) - {"s"}:
                    new = (cost + 3, letters + "I", (*lines, f"{ROLE[x]}:"))
                    if DUE[q][x] not in best or new[:2] < best[DUE[q][x]][:2]:
                        best[DUE[q][x]] = new
                        more = True
        return best

    best = inserted({0: (0, "", ())})
    for role, text, kind in rows:
        new = {}

        def offer(q, value):
            if q not in new or value[:2] < new[q][:2]:
                new[q] = value

        for q, (cost, letters, lines) in best.items():
            offer(q, (cost + 4, letters + "D", lines))
            if kind != turn_repair.GONE:
                extra = 3 * (kind == turn_repair.CUT_OFF)
                if role[:1] in DUE[q]:
                    offer(DUE[q][role[:1]], (cost + extra, letters + "K", (*lines, f"{role}:{text}")))
                for x in set(DUE[q]) - {"s"}:
                    offer(DUE[q][x], (cost + extra + 3, letters + "R", (*lines, f"{ROLE[x]}:{text}")))
        best = inserted(new)
    return min((best[q] for q in (0, 3) if q in best), key=lambda v: v[:2])


def plain(rows):
    found = []
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, turns in by_conv.items():
        left = []
        for turn, role, text in turns:
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fault = zlib.crc32(key.encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            left += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        mark = lambda r: hashlib.sha256(f"{' ' if conv is None else conv}\n{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()  # noqa: E731, B023
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, mark(r)))
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, role, text in left:
            end = text.strip(SPACES)[-1:]
            which = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None
            seen.add((role, text))
            if which is not None:
                counts[which] += 1
            kinds.append({None: turn_repair.FINE, 2: turn_repair.CUT_OFF}.get(which, turn_repair.GONE))
        known = [t for t, _, _ in left if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(left))
        cost, letters, lines = cheapest([(r, t, k) for (_, r, t), k in zip(left, kinds, strict=True)])
        found.append((conv, gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trace_equals_the_plain_programme_also_in_chunks():
    rng = random.Random(2)
    every = list(itertools.product("suax", range(3)))
    cases = [c for n in (1, 2, 3) for c in itertools.product(every, repeat=n)]
    cases += [[(rng.choice("suax" if rng.random() < 0.3 else "ua"), rng.choice((0, 0, 0, 1, 2))) for _ in range(rng.randrange(4, 40))] for _ in range(1000)]
    last = turn_repair.tables().last
    for case in cases:
        symbols = "".join(chr(ord("a") + "suax".index(i) * 3 + k) for i, k in case)
        letters, _, _, cost = turn_repair.trace(symbols, last, 0, True)
        assert (cost, letters) == cheapest([(i, "", k) for i, k in case])[:2]
        cut = rng.randrange(len(symbols) + 1)
        if 0 < cut < len(symbols):
            behind = int(turn_repair.summary(symbols[cut:])[last])
            a = turn_repair.trace(symbols[:cut], behind, 0, False)
            b = turn_repair.trace(symbols[cut:], last, a[2], True)
            assert (a[0] + b[0], a[3] + b[3]) == (letters, cost)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.QUERIES["op11_repair"](spark, f"/root/testdata/{sf}")) == plain(rows)


def test_edge_rows_and_a_hot_conversation(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "CHUNK", 16)
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "ua", "Âme"]
    texts = ["Yes.", "No!", "cut off", "", None, " \t\n", "Größe 😀?", "a\nb.", "x" * 100_000 + ".", "Yes."]
    rows = [(k % 7 if k % 7 else None, rng.choice([None, k, k // 2, -k]), rng.choice(roles), rng.choice(texts)) for k in range(300)]
    rows += [(99, k, rng.choice(roles[:3]), f"t{rng.randrange(150)}{rng.choice(['.', ''])}") for k in range(500)]
    rows += [(98, 1, "user", "Same row.")] * 200
    rows += [(c, t, "user", "Alone.") for c in range(1000, 1030) for t in (0,)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id bigint, turn bigint, role string, text string, at int, conv string").repartition(5)
    expected = plain(rows)
    assert rows_of(turn_repair.repair(df)) == expected
    assert any(r[0] is not None and r[0] >= 1000 and r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for r in expected)
    assert turn_repair.repair(df.limit(0)).count() == 0
