"""Licence scan: Aho-Corasick over word sequences, licence expressions by shunting-yard.

Every whole text is normalised to its words; one Aho-Corasick automaton finds notice
phrases (names, short names and openings of licences) and identifier tags
(``SPDX-License-Identifier``, ``licensed under``, fields such as ``license: MIT``) at once.
The licence expression after a tag (``and`` / ``or`` / ``with`` and brackets) is put into
postfix order by a shunting-yard and evaluated: ``and`` takes the stricter side, ``or`` the
freer. After an identifier tag or in a field it ends with its line, unless a bracket is
open or the line ends in an operator; in prose it may run on. An identifier of no known
family counts as ``other`` and doesn't end the expression. A phrase inside a longer one
(``creative commons attribution`` in ``creative commons attribution noncommercial``) gives no
label, unless it is a base phrase.

Cases: a null or empty text has no words, no label and score 0.0; phrases that
overlap all count; repeated rows give repeated results; an expression whose brackets
don't close counts as if all its licences were joined by ``and``; a very long text
takes time in proportion to its length; other columns are not looked at; an empty
table gives no rows. One narrow pass, no shuffle, memory for one batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotweave.llm.text import WORDS, blobs, doc_text, small

# The base phrases and labels that the query's contract names.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Further notice phrases (as lower-case words) and their labels.
MORE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
    # further names and short names
    "library general public license": "lgpl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "gnu agpl": "agpl",
    "gplv2": "gpl",
    "gplv3": "gpl",
    "lgplv2": "lgpl",
    "lgplv3": "lgpl",
    "agplv3": "agpl",
    "boost software license": "boost",
    "artistic license": "artistic",
    "zlib license": "zlib",
    "postgresql license": "postgresql",
    "the unlicense": "unlicense",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "open font license": "ofl",
    "open database license": "odbl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution no derivatives": "cc-by-nd",
    # openings of the licences' own texts
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "permission to use copy modify and distribute this software": "hpnd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is granted to anyone to use this software for any purpose": "zlib",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation": "boost",
}

#: Tags before a licence expression (as lower-case words) and what kind of text follows: an expression, prose, or after a colon or equals sign the value of a field.
TAGS = {
    "spdx license identifier": "expression",
    "licensed under": "prose",
    "licenced under": "prose",
    "licensed under the": "prose",
    "licenced under the": "prose",
    "license": "field",
    "licence": "field",
}

#: Families of licence identifiers by how much they restrict reuse, from 0 (free) to 1 (reserved).
FAMILIES = {
    0.0: "public-domain cc0 unlicense wtfpl pddl 0bsd mit-0 cc-pddc",
    0.1: "mit isc bsd x11 zlib ncsa hpnd fsfap ftl icu ijg libpng libtiff openssl postgresql psf python ruby php tcl unicode upl vim w3c xfree86 zend zpl curl blueoak bsl boost beerware json naist ntp xnet",
    0.15: "apache afl artistic ecl efl ms-pl mulanpsl naumen entessa intel",
    0.2: "cc-by odc-by",
    0.35: "mpl npl apsl cddl cpl ipl lppl lpl ms-rl nasa ofl qpl sissl spl watcom",
    0.4: "epl eupl cecill cpal ngpl",
    0.45: "lgpl",
    0.5: "cc-by-sa odbl gfdl osl rpl rpsl sleepycat other",
    0.6: "gpl",
    0.7: "agpl sspl parity",
    0.8: "cc-by-nd cc-by-nc busl elastic polyform commons-clause",
    1.0: "proprietary reserved licenseref",
}
RESTRICTION = {name: level for level, names in FAMILIES.items() for name in names.split()}

_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:\-]*)")
_LINE_END = re.compile(r"[\r\n]")
_BINDS = {"or": 1, "and": 2, "with": 3}
_BY_LENGTH = sorted(RESTRICTION, key=len, reverse=True)
_VERSION = re.compile(r"v?[0-9][0-9.]*\+?(?:$|-)|[-+]|$")


def family(identifier: str) -> str | None:
    """The known family of an identifier such as ``GPL-2.0-only``, ``gplv3`` or ``Apache-2.0``; the longest counts."""
    name = identifier.lower().rstrip(".:")
    return next((f for f in _BY_LENGTH if name.startswith(f) and _VERSION.match(name, len(f))), None)


def _identifier(token: str, strict: bool) -> bool:
    """Whether a word of prose can be a licence: a known family, or built like one (capitals or digits with a hyphen or dot)."""
    if strict:
        return True
    return family(token) is not None or bool(re.search(r"[A-Z0-9]", token) and re.search(r"[-.][A-Z0-9]", token))


def tokens_of(text: str, at: int, kind: str = "expression") -> list[str]:
    """The licence expression that starts at ``at``: operands and operators in turn, and brackets.

    After an identifier tag every word in an operand's place is one; in prose and fields
    it must look like one, and an operator without such an operand ends the expression.
    """
    out: list[str] = []
    depth, kept, operand = 0, 0, True
    while m := _TOKEN.match(text, at):
        t = m[1]
        low = t.lower()
        turned = kind != "prose" and not depth and _LINE_END.search(text, at, m.start(1)) is not None
        if turned and not operand:
            break
        strict = kind == "expression" and not (turned and not out)  # what stands below a bare tag may be prose
        if operand and t == "(":
            depth += 1
        elif operand and t != ")" and low not in _BINDS:
            after_with = bool(out) and out[-1].lower() == "with"
            # an exception of prose names itself one
            if not (_identifier(t, strict) if not after_with else strict or "exception" in low or out[-1] == "WITH"):
                break
            operand = False
        elif not operand and t == ")" and depth:
            depth -= 1
        elif not operand and low in _BINDS:
            operand = True
        else:
            break
        out.append(t.rstrip(".:") if t not in "()" else t)
        at = m.end()
        if not operand:
            kept = len(out)  # what follows an operand may be prose
            if t.endswith((".", ":")):
                break
    return out[:kept]


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: ``with`` binds tighter than ``and``, ``and`` tighter than ``or``; all left-associative."""
    out: list[str] = []
    held: list[str] = []
    for t in tokens:
        op = t.lower()
        if op in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[op]:
                out.append(held.pop())
            held.append(op)
        elif t == "(":
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("unbalanced )")
            held.pop()
        else:
            out.append(t)
    while held:
        if held[-1] == "(":
            raise ValueError("unbalanced (")
        out.append(held.pop())
    return out


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Restriction and labels: ``and`` takes the stricter side, ``or`` the freer, ``with`` its left side."""
    stack: list[tuple[float, set[str]]] = []
    for t in postfix:
        if t in _BINDS:
            if len(stack) < 2:
                raise ValueError("an operator lacks a side")
            right, left = stack.pop(), stack.pop()
            if t == "with":
                stack.append(left)
            else:
                stack.append(((max if t == "and" else min)(left[0], right[0]), left[1] | right[1]))
        else:
            label = family(t) or "other"
            stack.append((RESTRICTION[label], {label}))
    if len(stack) != 1:
        raise ValueError("an operator is missing")
    return stack[0]


def expression_at(text: str, at: int, kind: str = "expression") -> tuple[float, set[str]] | None:
    """Restriction and labels of the licence expression that starts at ``at``; None if there is none."""
    tokens = tokens_of(text, at, kind)
    if not tokens:
        return None
    try:
        return evaluate(to_postfix(tokens))
    except ValueError:  # brackets that don't close: all of its licences
        words = [t for i, t in enumerate(tokens) if t not in "()" and t.lower() not in _BINDS and (not i or tokens[i - 1].lower() != "with")]
        return evaluate(to_postfix(" and ".join(words).split()))


def automaton(phrases: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, kind in TAGS.items():
        a.add_word(f" {phrase} ", (None, phrase, kind))
    for phrase, label in phrases.items():
        a.add_word(f" {phrase} ", (label, phrase, None))
    a.make_automaton()
    return a


def scan_text(raw: bytes | None, machine: ahocorasick.Automaton, base: frozenset[str]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, n_expressions) of one text; ``base``: the phrases whose places count."""
    flat = (raw or b"").translate(WORDS)
    words = flat.split()
    # latin-1 keeps one character a byte, so that positions stay byte positions
    line = b" " + b" ".join(words) + b" "
    hits = list(machine.iter(line.decode("latin-1")))
    labels: set[str] = set()
    found_base: set[str] = set()
    places: list[int] = []
    tags: dict[int, str] = {}  # word after the tag
    if hits:
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        at = np.searchsorted(blanks, [end - len(hit[1]) - 1 for end, hit in hits]).tolist()
        after = np.searchsorted(blanks, [end for end, _ in hits]).tolist()
        notices = [(first, -behind, label, phrase) for (_, (label, phrase, _)), first, behind in zip(hits, at, after, strict=True) if label is not None]
        for (_, (label, _, kind)), behind in zip(hits, after, strict=True):
            if label is None:
                tags[behind] = kind
        reach = 0  # how far the phrases that start no later go
        for first, behind, label, phrase in sorted(notices):
            counted = phrase in base
            if counted:
                found_base.add(label)
                places.append(first)
            if counted or -behind > reach:
                labels.add(label)
            reach = max(reach, -behind)
    score = max((RESTRICTION.get(x, RESTRICTION["other"]) for x in labels), default=0.0)
    found = []
    if tags:
        space = np.frombuffer(flat, np.uint8) == 32
        ends = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1) == 1)  # byte after each word
        text = raw.decode("latin-1")
        # "licensed under" ends where "licensed under the" goes on: the longer tag is the one that is followed by an expression
        for word, kind in sorted(tags.items()):
            begin = (_FIELD if kind == "field" else _COLON).match(text, int(ends[word - 1]))
            if begin and (x := expression_at(text, begin.end(), kind)):
                found.append(x)
    if found:
        # an expression decides for the licences that it names; other notices still restrict
        named = set().union(*(x[1] for x in found))
        score = max([x[0] for x in found] + [RESTRICTION.get(x, RESTRICTION["other"]) for x in labels - named])
        labels |= named
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found_base)), ",".join(sorted(labels)), float(score), len(found)


_COLON = re.compile(r"(?:[ \t]*:)?")
_FIELD = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?(?=[^ \t\r\n])")

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_expressions long"


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): places, labels and restriction score of licence notices.

    ``base``: phrases (lower-case words joined by one space) whose places are
    counted; ``more``: phrases that only add labels.
    """
    base = BASE_PHRASES if base is None else base
    more = MORE_PHRASES if more is None else more
    phrases, counted = {**more, **base}, frozenset(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(phrases)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        for b in small(batches):
            rows = [scan_text(t, machine, counted) for t in blobs(b.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")]
            )

    return doc_text(docs).mapInArrow(run, SCHEMA)
