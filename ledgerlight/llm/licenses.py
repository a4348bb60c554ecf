"""Licence scans: phrases and identifier tags found by Aho-Corasick automata, licence expressions parsed and evaluated.

Notices: a text's words (A-Z lower-cased, runs of ``[0-9a-z]`` and of anything outside ASCII) are joined by single spaces,
and one automaton over that finds every place of every phrase, overlapping ones included. Base phrases are always kept;
another phrase that lies within a longer one found there is left out.

Tags: a second automaton over the lower-cased text finds identifier tags. The expression after a tag is read token by token
into a shunting-yard parser (``with`` binds closest, then ``and``, then ``or``; ``/`` is an old way to write ``or``), which
ends at the first token that can't go on. Its value is what the expression asks for: a choice asks for the least of its
sides, ``and`` for the most, an exception for one step less of a copyleft licence. Both run in a text's length.

The score is 1 less the product of (1 - strength) over the labels, each by its strongest evidence; 0 without a label.

Defined results: null and empty texts have no words and no label; null ids, repeated rows and ties are as any other; very
long texts are scanned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import bounded, slices

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_STRENGTH, TAG_STRENGTH = 0.9, 0.99
# Phrases of notices, as words: label and strength.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "licensed under the mit": ("mit", 0.8),
    "licensed under the apache": ("apache", 0.8),
    "lesser general public license": ("lgpl", 0.9),
    "library general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "gnu gpl": ("gpl", 0.7),
    "gnu lgpl": ("lgpl", 0.7),
    "gnu agpl": ("agpl", 0.7),
    "bsd license": ("bsd", 0.9),
    "2 clause bsd": ("bsd", 0.9),
    "3 clause bsd": ("bsd", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "european union public licence": ("eupl", 0.9),
    "boost software license": ("bsl", 0.9),
    "isc license": ("isc", 0.9),
    "zlib license": ("zlib", 0.9),
    "unlicense": ("unlicense", 0.5),
    "released into the public domain": ("public-domain", 0.8),
    "dedicated to the public domain": ("public-domain", 0.8),
    "cc0 1 0": ("cc0", 0.9),
    "creative commons zero": ("cc0", 0.9),
    "cc by 3 0": ("cc-by", 0.9),
    "cc by 4 0": ("cc-by", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons attribution sharealike": ("cc-by-sa", 0.9),
    "creative commons attribution share alike": ("cc-by-sa", 0.9),
    "creative commons attribution noderivatives": ("cc-by-nd", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9),
    "creative commons attribution noncommercial sharealike": ("cc-by-nc-sa", 0.9),
    "creative commons attribution noncommercial noderivatives": ("cc-by-nc-nd", 0.9),
    "all rights reserved": ("rights-reserved", 0.3),
}
TAGS = ("spdx-license-identifier:", "spdx-license-expression:", "license-expression:")
# What licences ask for, by the letters that their identifiers start with.
PERMISSIVE, WEAK, STRONG, UNKNOWN = range(4)
NEEDS = ("permissive", "weak copyleft", "strong copyleft", "unknown")
FAMILIES = {
    "mit": PERMISSIVE, "apache": PERMISSIVE, "bsd": PERMISSIVE, "isc": PERMISSIVE, "zlib": PERMISSIVE, "bsl": PERMISSIVE, "unlicense": PERMISSIVE, "cc0": PERMISSIVE, "cc-by": PERMISSIVE, "psf": PERMISSIVE,
    "lgpl": WEAK, "mpl": WEAK, "epl": WEAK, "eupl": WEAK,
    "gpl": STRONG, "agpl": STRONG, "cc-by-sa": STRONG,
}
OPERATORS = {b"or": 1, b"/": 1, b"and": 2, b"with": 3}
_TOKEN = re.compile(rb"[ \t]*([()/]|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?)")
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def license_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


# ---------------------------------------------------------------- expressions


@dataclass(frozen=True)
class Expression:
    """A parsed expression: its operands and operators in postfix order, or None if it isn't one."""

    text: str
    postfix: tuple[str, ...] | None


def parse(text: bytes, at: int = 0) -> Expression:
    """Shunting-yard: the licence expression that starts at a byte of ``text``, up to the first token that can't go on."""
    out: list[str] = []
    held: list[bytes] = []
    start, end, depth, wanted = at, at, 0, True  # wanted: an operand comes next

    def apply(least: int) -> None:
        while held and held[-1] != b"(" and OPERATORS[held[-1]] >= least:
            out.append(held.pop().decode())

    while found := _TOKEN.match(text, at):
        token, low = found[1], found[1].lower()
        if token == b"(" and wanted:
            held.append(token)
            depth += 1
        elif token == b")" and not wanted and depth:
            apply(0)
            held.pop()
            depth -= 1
        elif low in OPERATORS and not wanted:
            apply(OPERATORS[low])
            held.append(b"or" if low == b"/" else low)
            wanted = True
        elif wanted and low not in OPERATORS and token not in (b"(", b")"):
            out.append(token.decode())
            wanted = False
        else:
            break
        at = end = found.end()
    whole = not wanted and not depth
    apply(0)
    return Expression(text[start:end].strip().decode(), tuple(out) if whole else None)


def family(identifier: str) -> str:
    """The family of a licence identifier: the known one that it starts with, or ``other``."""
    low = identifier.lower()
    starts = [f for f in FAMILIES if re.match(re.escape(f) + r"(?![a-z])", low)]
    found = max(starts, key=len, default="other")
    if found == "cc-by" and (kind := re.match(r"cc-by((?:-(?:nc|nd|sa))+)", low)):
        return "cc-by" + kind[1]
    return found


def evaluate(postfix: tuple[str, ...]) -> tuple[int, list[str]]:
    """What an expression asks for, and the families of its licences (exceptions are none)."""
    needs: list[int] = []
    names: list[str] = []
    operands: list[int] = []  # places in names, to take back an exception's
    for token in postfix:
        if token in ("or", "and"):
            b, a = needs.pop(), needs.pop()
            operands.pop()
            needs.append(min(a, b) if token == "or" else max(a, b))
        elif token == "with":
            needs.pop()
            names[operands.pop()] = ""
            needs[-1] = {STRONG: WEAK, WEAK: PERMISSIVE}.get(needs[-1], needs[-1])
        else:
            name = family(token)
            operands.append(len(names))
            names.append(name)
            needs.append(FAMILIES.get(name, UNKNOWN))
    return needs[0], sorted({n for n in names if n})


# ---------------------------------------------------------------- automata


@cache
def _phrases(base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, tuple[str, float]], ...]) -> ahocorasick.Automaton:
    """Over words joined by spaces, a byte a character: (phrase, its words, label, strength, whether base)."""
    found = ahocorasick.Automaton()
    for phrase, (label, strength) in [*notices, *((p, (label, BASE_STRENGTH)) for p, label in base)]:
        words = license_words(phrase.encode())
        found.add_word(f" {b' '.join(words).decode('latin-1')} ", (phrase, len(words), label, strength, (phrase, label) in base))
    found.make_automaton()
    return found


@cache
def _tags(tags: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for t in tags:
        found.add_word(t, t)
    found.make_automaton()
    return found


@dataclass
class Scan:
    n_words: int
    places: list[dict]  # phrase, label, start (word number), base
    expressions: list[dict]  # tag, expression, valid, needs, labels
    labels: list[str]
    score: float


def scan(text: bytes, base: dict = BASE, notices: dict = NOTICES, tags: tuple[str, ...] = TAGS) -> Scan:
    words = license_words(text)
    joined = f" {b' '.join(words).decode('latin-1')} "
    found, seen, upto = [], 0, 0
    for end, (phrase, size, label, strength, is_base) in _phrases(tuple(base.items()), tuple(notices.items())).iter(joined):
        seen, upto = seen + joined.count(" ", upto, end), end  # words that end here
        found.append((seen - size, seen, phrase, label, strength, is_base))
    strengths: dict[str, float] = {}
    places, reach = [], 0
    for start, end, phrase, label, strength, is_base in sorted(found, key=lambda f: (f[0], -f[1])):
        if is_base or end > reach:  # else within a longer one
            places.append({"phrase": phrase, "label": label, "start": start, "base": is_base})
            strengths[label] = max(strengths.get(label, 0.0), strength)
        reach = max(reach, end)
    expressions, lower, upto = [], text.lower().decode("latin-1"), 0
    for end, tag in _tags(tags).iter(lower):
        if end < upto:  # a tag whose end is another tag's
            continue
        one = parse(text, end + 1)
        upto = end + 1
        needs, named = evaluate(one.postfix) if one.postfix else (UNKNOWN, [])
        expressions.append({"tag": tag, "expression": one.text, "valid": one.postfix is not None, "needs": NEEDS[needs], "labels": named})
        for label in named:
            strengths[label] = max(strengths.get(label, 0.0), TAG_STRENGTH)
    miss = 1.0
    for label in sorted(strengths):
        miss *= 1 - strengths[label]
    return Scan(len(words), places, expressions, sorted(strengths), 1 - miss)


def scan_licenses(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict = BASE, notices: dict = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """(id_col, n_words, places, expressions, labels, score) for each row: phrases by place, the expressions of tags with
    what they ask for, and the distinct labels in order. ``base`` maps phrases to labels, ``notices`` to labels and
    strengths."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    place = pa.struct([("phrase", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("base", pa.bool_())])
    expression = pa.struct([("tag", pa.string()), ("expression", pa.string()), ("valid", pa.bool_()), ("needs", pa.string()), ("labels", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets, _ in slices(batch.column(1)):
                found = [scan(buf[offsets[i] : offsets[i + 1]].tobytes(), base, notices, tags) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([s.n_words for s in found], pa.int64()), pa.array([s.places for s in found], pa.list_(place)), pa.array([s.expressions for s in found], pa.list_(expression)),
                     pa.array([s.labels for s in found], pa.list_(pa.string())), pa.array([s.score for s in found], pa.float64())],
                    ["_id", "n_words", "places", "expressions", "labels", "score"],
                )

    schema = f"_id {kind}, n_words long, places array<struct<phrase:string,label:string,start:bigint,base:boolean>>, expressions array<struct<tag:string,expression:string,valid:boolean,needs:string,labels:array<string>>>, labels array<string>, score double"
    return docs.mapInArrow(bounded(run), schema).withColumnRenamed("_id", id_col)
