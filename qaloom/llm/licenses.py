"""Licence scan: one Aho-Corasick pass per text, and a shunting-yard parser for tagged expressions.

A text's words (A-Z lowered) are written with single spaces, so that a phrase found between spaces is a run of
consecutive words; overlapping places all count. One automaton holds the base phrases, the notices and the words of the
identifier tag. Where the tag occurs, the rest of its line is parsed as an expression of identifiers, ``and``, ``or``,
``with`` and parentheses.

Permission of a licence goes from 0 to 1 (``PERMISSION``); unknown identifiers have 0. ``or`` takes the larger value,
``and`` the smaller, ``with`` lifts a licence halfway to 1. A text's score is the smallest over its notices and tags, and 0 without
any. An expression that cannot be parsed counts as unknown, with the label ``unparsed``.

The work is one map over whole texts without a shuffle. Rows: a null text is empty (no words, no labels, score
0); repeated rows are scanned each for itself; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import doc_texts, map_batches, utf8, words

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases (words as the scan sees them) and the licence each names.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "creative commons zero": "cc0-1.0",
    "cc0": "cc0-1.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
}
TAG = "spdx license identifier"
_TAG = re.compile(rb"spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier[^\S\n]*:?([^\n]*)", re.IGNORECASE)
# Permission by the start of an identifier; the longest start that fits counts.
PERMISSION = {
    "0bsd": 1.0, "apache": 1.0, "bsd": 1.0, "cc0": 1.0, "isc": 1.0, "mit": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0,
    "cc-by": 0.9, "epl": 0.6, "lgpl": 0.6, "mpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2,
    "reserved": 0.1,
}
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKENS = re.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")
_IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*")


def permission(identifier: str) -> float:
    start = max((k for k in PERMISSION if identifier.lower().startswith(k)), key=len, default=None)
    return 0.0 if start is None else PERMISSION[start]


def postfix(expression: str) -> list[str]:
    """The expression in postfix order, by two stacks; raises ``ValueError`` where it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last token ended an operand
    for token in _TOKENS.findall(expression):
        operator = token.lower()
        if operator in _PRECEDENCE:
            if not operand:
                raise ValueError("operator without operand")
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[operator]:
                out.append(stack.pop())
            stack.append(operator)
            operand = False
        elif token == "(":
            if operand:
                raise ValueError("operand before parenthesis")
            stack.append(token)
        elif token == ")":
            if not operand:
                raise ValueError("parenthesis without operand")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unopened parenthesis")
            stack.pop()
        else:
            if operand or not _IDENTIFIER.fullmatch(token):
                raise ValueError("not an identifier")
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        raise ValueError("unfinished expression")
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[float, list[str]]:
    """Permission of an expression and the identifiers it names, lower-cased."""
    stack: list[tuple[float, str]] = []
    names: list[str] = []
    for token in postfix(expression):
        if token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                if not right[1]:
                    raise ValueError("an exception is a name")
                value = left[0] + (1 - left[0]) / 2 if left[0] else 0.0
            else:
                value = max(left[0], right[0]) if token == "or" else min(left[0], right[0])
            stack.append((value, ""))
        else:
            names.append(token.lower())
            stack.append((permission(token), token))
    return stack[0][0], names


def automaton(base: dict[str, str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    phrases: dict[str, list] = {}
    for kind, table in (("base", base), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in table.items():
            phrases.setdefault(phrase, []).append((kind, label))
    for phrase, meanings in phrases.items():
        # The scanned line is UTF-8 read as Latin-1, one character a byte; so are the phrases.
        found.add_word(f" {phrase} ".encode().decode("latin-1"), (phrase, meanings))
    found.make_automaton()
    return found


def scan_text(text: bytes, found) -> tuple[int, list[tuple[str, int]], list[str], list[str], float]:
    """Words, base places (phrase, first word), base labels, all labels, score."""
    split = words(text)
    line = (b" " + b" ".join(split) + b" ").decode("latin-1")
    places, base_labels, labels, values, tagged = [], set(), set(), [], False
    seen, word = 0, 0
    for end, (phrase, meanings) in found.iter(line):
        # Ends only grow: count the spaces up to here once, then step back over the phrase.
        word += line.count(" ", seen, end)
        seen = end
        first = word - phrase.count(" ") - 1
        for kind, label in meanings:
            if kind == "base":
                places.append((phrase, first))
                base_labels.add(label)
            elif kind == "tag":
                tagged = True
                continue
            labels.add(label)
            values.append(permission(label))
    if tagged:
        for rest in _TAG.findall(text):
            expression = rest.decode("utf-8", "replace").strip(" \t\r*/#;-<>!")
            try:
                value, names = evaluate(expression)
                labels.update(names)
            except ValueError:
                value = 0.0
                labels.add("unparsed")
            values.append(value)
    return len(split), places, sorted(base_labels), sorted(labels), min(values, default=0.0)


SPANS = (
    "doc_id bigint, n_words bigint, places array<struct<phrase: string, first_word: bigint>>, base_labels array<string>,"
    " labels array<string>, score double"
)


def scan(docs: DataFrame, base: dict[str, str] | None = None) -> DataFrame:
    """Per document: its words, every place of a base phrase, labels and score.

    ``base`` maps phrases, in words as the scan sees them, to labels.
    """
    base = BASE if base is None else base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(base)
        place = pa.list_(pa.struct([("phrase", pa.string()), ("first_word", pa.int64())]))
        for batch in batches:
            rows = [scan_text(text, found) for text in utf8(batch)]
            n, places, base_labels, labels, score = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array([[{"phrase": p, "first_word": i} for p, i in x] for x in places], place),
                    pa.array(base_labels, pa.list_(pa.string())),
                    pa.array(labels, pa.list_(pa.string())),
                    pa.array(score, pa.float64()),
                ],
                names=["doc_id", "n_words", "places", "base_labels", "labels", "score"],
            )

    return map_batches(doc_texts(docs), run, SPANS)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and joined labels of ``scan``'s spans."""
    starts = F.transform("places", lambda p: p["first_word"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
