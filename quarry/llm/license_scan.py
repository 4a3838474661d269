"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases over a text's words; the expression
after a tag is put in postfix order by a shunting yard and evaluated.

Defined results: null or empty text has no words and no labels and scores 0; a null doc_id keeps its row; repeated
rows are scanned alike; an empty table gives an empty result; further columns are ignored; an expression that doesn't
parse adds the labels of the identifiers in it and does not count in the score.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, table

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases and their labels. Where one phrase begins another, the longer one counts.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "cc0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# How freely a label's texts may be used, from 1 (freely) to 0.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "bsl": 0.9, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6,
    "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "proprietary": 0.0,
}
#: What a label that isn't in FREEDOM, and an exception after WITH, count.
UNKNOWN, EXCEPTION = 0.3, 0.1

_EXPRESSION = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\n]*)", re.IGNORECASE | re.ASCII)
_PIECE = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_VERSION = re.compile(r"-?v?\d+(\.\d+)*(-only|-or-later|-clause.*)?\+?$|-(only|or-later)$|\+$")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BINDS = {"or": 1, "and": 2, "with": 3}


def label(identifier: str) -> str:
    """The label of an identifier: lower case, without its version."""
    return _VERSION.sub("", identifier.lower()) or identifier.lower()


def postfix(expression: str) -> list[str] | None:
    """The expression's identifiers and operators in postfix order; None if it doesn't parse."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # what must come next
    for piece in _PIECE.findall(expression):
        low = piece.lower()
        if low in _BINDS:
            if operand:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif piece == "(":
            if not operand:
                return None
            held.append(piece)
        elif piece == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                return None
            out.append(piece)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], float | None]:
    """Labels in the expression and its freedom: OR takes the freest side, AND the strictest, WITH adds an exception."""
    order = postfix(expression)
    if order is None:
        return {label(p) for p in _PIECE.findall(expression) if p not in "()" and p.lower() not in _BINDS and label(p) in FREEDOM}, None
    stack: list[tuple[set[str], float]] = []
    for x in order:
        if x not in _BINDS:
            stack.append(({label(x)}, FREEDOM.get(label(x), UNKNOWN)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        stack.append((left | right, max(a, b)) if x == "or" else (left | right, min(a, b)) if x == "and" else (left, min(1.0, a + EXCEPTION)))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None, words: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    folded = (text or "").encode("utf-8").translate(_FOLD).split()
    row = " " + b" ".join(folded).decode("utf-8") + " "
    base: list[tuple[int, str]] = []
    notices: dict[int, str] = {}
    tagged, at, counted = False, 0, 0
    for end, phrase in words.iter(row):
        if phrase == TAG:
            tagged = True
            continue
        start = end - len(phrase) - 1
        if phrase in BASE:
            # Ends only grow, but a longer phrase can begin earlier.
            counted, at = (counted + row.count(" ", at, start), start) if start >= at else (row.count(" ", 0, start), start)
            base.append((counted, BASE[phrase]))
        else:
            notices[start] = NOTICES[phrase]
    labels = {x for _, x in base} | set(notices.values())
    freedoms = [FREEDOM[x] for x in labels]
    if tagged:
        for m in _EXPRESSION.finditer(text):
            more, freedom = evaluate(m[1])
            labels |= more
            freedoms += [] if freedom is None else [freedom]
    where = [i for i, _ in base]
    return (
        len(folded), len(base), min(where, default=None), max(where, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), min(freedoms, default=0.0),
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and scan() of every row: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    bounded_batches(docs.sparkSession)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        words = automaton()
        for b in batches:
            cols = list(zip(*(scan(t, words) for t in b.column(1).to_pylist()), strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
