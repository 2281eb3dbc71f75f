"""Licence scans: notices and identifier tags found by Aho-Corasick.

One automaton holds all phrases, over a text's words joined by single blanks. It
finds the base phrases, the longer notices below and the words of the
identifier tag. Behind a tag, the longest licence expression in its line is read by a
shunting-yard parser (``OR`` binds weakest, then ``AND``, then ``WITH``; ``+``
belongs to its identifier), which also tells whether a set of accepted licences
satisfies it. A malformed expression gives no labels.

The score says how sure it is that the text carries a licence: one minus the
product of what each kind of evidence leaves open (a valid tag 0.1, a notice
0.3, a base phrase 0.4).

Defined results: null and empty texts have no words and score 0; a repeated row
is scanned again; places are counted for every occurrence, also overlapping
ones; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contexture.llm import words

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

NOTICES = {
    "under the apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu affero general public license version 3": "agpl-3.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "mozilla public license 2 0": "mpl-2.0",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "cc0 1 0": "cc0-1.0",
    "creative commons attribution 4 0 international": "cc-by-4.0",
    "all rights reserved": "all-rights-reserved",
}

TAG = "spdx license identifier"
_TAG = re.compile(r"spdx-license-identifier:", re.IGNORECASE)
_PIECE = re.compile(r"\s*(?:([()])|([A-Za-z0-9.:-]+\+?))")
_STEP = re.compile(r"[^\S\r\n]*(?:([()])|([A-Za-z0-9.:-]+\+?))")
_BINDS = {"or": 1, "and": 2, "with": 3}

SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
    "base_labels string, labels string, score double"
)


class Malformed(ValueError):
    """An expression that cannot be read."""


def _trimmed(text: str) -> str:
    """``text`` without blanks and comment ends behind it."""
    end = len(text)
    while end:
        if text[end - 1].isspace() or text[end - 1] == "#":
            end -= 1
        elif text.endswith("*/", 0, end):
            end -= 2
        elif text.endswith("-->", 0, end):
            end -= 3
        else:
            break
    return text[:end]


def to_postfix(expression: str) -> list[str]:
    """The expression's identifiers and operators in postfix order, lower-cased."""
    text = _trimmed(expression)
    out: list[str] = []
    held: list[str] = []
    at, wanted = 0, True
    while at < len(text):
        found = _PIECE.match(text, at)
        if not found:
            raise Malformed(expression)
        at = found.end()
        bracket, word = found.groups()
        piece = (bracket or word).lower()
        if piece == "(":
            if not wanted:
                raise Malformed(expression)
            held.append(piece)
        elif piece == ")":
            if wanted:
                raise Malformed(expression)
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise Malformed(expression)
            held.pop()
        elif piece in _BINDS:
            if wanted:
                raise Malformed(expression)
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[piece]:
                out.append(held.pop())
            held.append(piece)
            wanted = True
        else:
            if not wanted:
                raise Malformed(expression)
            out.append(piece)
            wanted = False
    if wanted or "(" in held:
        raise Malformed(expression)
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[list[str], list[str]]:
    """The licences named, each with its exception, and the postfix over these."""
    stack: list[str | None] = []
    names: list[str] = []
    reduced: list[str] = []
    for piece in postfix:
        if piece == "with":
            exception, licence = stack.pop(), stack.pop()
            if licence is None or exception is None:
                raise Malformed("with joins a licence and an exception")
            names[-2:] = [f"{licence} with {exception}"]
            reduced[-2:] = names[-1:]
            stack.append(None)
        elif piece in _BINDS:
            stack[-2:] = [None]
            reduced.append(piece)
        else:
            stack.append(piece)
            names.append(piece)
            reduced.append(piece)
    return names, reduced


def satisfied(expression: str, accepted: set[str]) -> bool:
    """Whether the accepted licences, lower-cased, fulfil the expression."""
    _, reduced = evaluate(to_postfix(expression))
    stack: list[bool] = []
    for piece in reduced:
        if piece in ("and", "or"):
            right, left = stack.pop(), stack.pop()
            stack.append(left and right if piece == "and" else left or right)
        else:
            stack.append(piece in accepted)
    return stack[0]


def leading(text: str, at: int = 0) -> str:
    """The longest expression that begins at ``at`` and ends in the same line.

    It stops before the first piece that cannot go on: other signs, a second
    licence without an operator, a bracket that nothing opened, or an exception
    to more than one licence. A full stop, colon or dash behind a licence is not
    part of it and ends the expression. An operator where a licence must stand
    makes the whole malformed.
    """
    start = end = at
    groups: list[list[bool]] = []  # open brackets: behind WITH, and with an operator inside
    last, single = "", False  # the piece before, and whether it is one licence
    while True:
        found = _STEP.match(text, at)
        if not found:
            break
        bracket, word = found.groups()
        piece = (bracket or word).lower()
        at = stop = found.end()
        wanted = last in ("", "(") or last in _BINDS
        if piece == "(":
            if not wanted:
                break
            groups.append([last == "with", False])
        elif piece == ")":
            if wanted or not groups:
                break
            behind_with, several = groups.pop()
            if behind_with and several:
                break
            single = not (behind_with or several)
        elif piece in _BINDS:
            if wanted:
                raise Malformed(text[start:stop])
            if piece == "with" and not single:
                break
            if groups:
                groups[-1][1] = True
        else:
            name = piece.rstrip(".:-")
            stop -= len(piece) - len(name)
            if not wanted or not name or name == "spdx-license-identifier":
                break
            single = last != "with"
        last = piece
        if piece not in _BINDS and not groups:
            end = stop
        if stop < at:
            break
    return text[start:end]


def tag_labels(text: str) -> list[str]:
    """Licences named by the text's identifier tags."""
    out: list[str] = []
    for found in _TAG.finditer(text):
        try:
            out += evaluate(to_postfix(leading(text, found.end())))[0]
        except Malformed:
            continue
    return [name.replace(" with ", "-with-") for name in out]


def _automaton(base: dict[str, str], notices: dict[str, str]):
    import ahocorasick

    held: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", base), ("notice", notices), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            held.setdefault(phrase, []).append((kind, label))
    automaton = ahocorasick.Automaton()
    for phrase, meanings in held.items():
        automaton.add_word(f" {phrase} ", (len(phrase.split(" ")), meanings))
    automaton.make_automaton()
    return automaton


# Everything that is no byte of a word is a blank; A-Z are lower-cased.
_TO_WORDS = bytes(int(words.LOWER[x]) if words.ALNUM[x] else 0x20 for x in range(256))


def _scan(raw: bytes, automaton) -> tuple:
    own = raw.translate(_TO_WORDS).split()
    joined = f" {b' '.join(own).decode('utf-8', 'replace')} "
    starts: list[int] = []
    labels: dict[str, set[str]] = {"base": set(), "notice": set(), "tag": set()}
    tagged = False
    # Ends ascend, so blanks are counted once along the text.
    counted = blanks = 0
    for end, (n_words, meanings) in automaton.iter(joined):
        blanks, counted = blanks + joined.count(" ", counted, end + 1), end + 1
        for kind, label in meanings:
            if kind == "base":
                starts.append(blanks - 1 - n_words)
            if kind == "tag":
                tagged = True
            else:
                labels[kind].add(label)
    if tagged:
        labels["tag"].update(tag_labels(raw.decode("utf-8", "replace")))
    open_ = (0.1 if labels["tag"] else 1) * (0.3 if labels["notice"] else 1)
    open_ *= 0.4 if labels["base"] else 1
    return (
        len(own),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(labels["base"])),
        ",".join(sorted(set().union(*labels.values()))),
        1.0 - open_,
    )


def scanned(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    base: dict[str, str] = BASE,
    notices: dict[str, str] = NOTICES,
) -> DataFrame:
    """Every document with its licence notices and labels."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(base, notices)
        for batch, raw, offsets in words.chunks(batches, "text"):
            data, at = raw.tobytes(), offsets.tolist()
            rows = [_scan(data[a:b], automaton) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [pa.array(column) for column in zip(*rows, strict=True)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [column.cast(kind) for column, kind in zip(columns, kinds, strict=True)],
                names=[part.split()[0] for part in SCHEMA.split(", ")],
            )

    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    return rows.mapInArrow(scan, SCHEMA)
