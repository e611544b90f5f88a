"""Licence notices and identifier tags in texts, with the licence expressions that follow tags.

Two automata run over each whole text: one over its words for notices such as "general public license", one over its lower-cased
bytes for tags such as `SPDX-License-Identifier:`. What follows a tag on its line is read as an expression of identifiers with
`or`, `and`, `with`, `+` and brackets, by a shunting yard, and evaluated to how much the licence asks of those who pass the work
on: the least of alternatives, the most of what holds together, and less with an exception for linking.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, slices, utf8

# Notices of the base, in words, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notices, in words.
NOTICES = {
    "affero general public license": "agpl",
    "all rights reserved": "proprietary",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "licensed under cc by": "cc-by",
    "licensed under the agpl": "agpl",
    "licensed under the apache": "apache",
    "licensed under the gpl": "gpl",
    "licensed under the lgpl": "lgpl",
    "licensed under the mit": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
}

#: Tags; those marked as loose also stand in prose, so that only known identifiers follow them.
TAGS = {"spdx-license-identifier:": False, "license:": True, "licence:": True, "license-expression:": True, "license =": True, "license=": True}

#: Starts of identifiers, their labels, and how much each asks: 0 next to nothing, 1 of the file or library, 2 of the whole work.
FAMILIES = {
    "0bsd": ("bsd", 0),
    "agpl": ("agpl", 2),
    "apache": ("apache", 0),
    "bsd": ("bsd", 0),
    "bsl": ("bsl", 0),
    "cc-by": ("cc-by", 0),
    "cc-by-sa": ("cc-by-sa", 2),
    "cc0": ("cc0", 0),
    "epl": ("epl", 1),
    "gpl": ("gpl", 2),
    "isc": ("isc", 0),
    "lgpl": ("lgpl", 1),
    "mit": ("mit", 0),
    "mpl": ("mpl", 1),
    "unlicense": ("unlicense", 0),
    "zlib": ("zlib", 0),
}

#: What an identifier of no known family asks, and parts of the names of exceptions that free linked works.
UNKNOWN_ASKS, LINKING = 2, ("classpath", "llvm", "gcc", "linking", "openssl", "font")

#: Belief that a place of each kind states a licence; places join by noisy-or.
BELIEF = {"base": 0.6, "notice": 0.5, "tag": 0.95}

#: Bytes of a long text that an automaton reads at a time.
CHUNK = 4 << 20

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_IS_WORD = frozenset(c for c in range(256) if _WORD_BYTES[c] != 32)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"[ \t\"']*(?:(\()|(\))|([A-Za-z0-9][A-Za-z0-9.:_-]*)(\+?))")
_PRIORITY = {"or": 1, "and": 2, "with": 3}


def known(name: str) -> tuple[str, int] | None:
    """The label of an identifier, by the longest family that it is or that it starts with before a hyphen or digit, and what it asks."""
    name = name.lower()
    for n in range(len(name), 2, -1):
        if name[:n] in FAMILIES and not name[n : n + 1].isalpha():
            return FAMILIES[name[:n]]
    return None


def tokens(text: str, loose: bool, at: int = 0) -> list[str]:
    """Tokens of the expression that stands in text at a place, as far as its line and its grammar go."""
    out, operand, depth = [], False, 0
    while m := _TOKEN.match(text, at):
        opens, closes, name, plus = m.groups()
        name = name and name.rstrip(".:_-")
        if opens and not operand:
            depth += 1
            out.append("(")
        elif closes and operand and depth:
            depth -= 1
            out.append(")")
        elif name and name.lower() in _PRIORITY and operand and not plus:
            out.append(name.lower())
            operand = False
        elif name and name.lower() not in _PRIORITY and not operand:
            if loose and not (out and out[-1] == "with") and known(name) is None:
                break
            out.append(name + plus)
            operand = True
        else:
            break
        at = m.end()
        if name and m.group(3) != name:  # a mark after the identifier ends the expression
            break
    while out and (out[-1] in _PRIORITY or out[-1] == "("):
        depth -= out.pop() == "("
    return out + [")"] * depth  # a bracket that is never closed closes at the end


def postfix(parts: list[str]) -> list[str]:
    """Operands before their operators, by the shunting yard; `with` binds closest, then `and`, then `or`, all to the left."""
    out, waiting = [], []
    for t in parts:
        if t in _PRIORITY:
            while waiting and waiting[-1] != "(" and _PRIORITY[waiting[-1]] >= _PRIORITY[t]:
                out.append(waiting.pop())
            waiting.append(t)
        elif t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            out.append(t)
    return out + waiting[::-1]


def evaluate(parts: list[str]) -> tuple[str, int, list[str]]:
    """The expression with one space between its tokens, what it asks, and the labels of its identifiers."""
    stack: list[tuple[str, int]] = []
    labels, plain = set(), postfix(parts)
    for i, t in enumerate(plain):
        if t not in _PRIORITY:
            label, asks = known(t) or (t.lower().rstrip("+"), UNKNOWN_ASKS)
            if plain[i + 1 : i + 2] != ["with"]:  # else it is an exception, no licence
                labels.add(label)
            stack.append((t, asks))
            continue
        (right, b), (_, a) = stack.pop(), stack.pop()
        if t == "with":
            a = min(a, 1) if any(x in right.lower() for x in LINKING) else a
        else:
            a = min(a, b) if t == "or" else max(a, b)
        stack.append(("", a))
    return " ".join(parts), stack[-1][1], sorted(labels)


@cache
def _automata():
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in {**BASE, **NOTICES}.items():
        words.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, "base" if phrase in BASE else "notice"))
    for tag, loose in TAGS.items():
        tags.add_word(tag, (len(tag), loose))
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def notices(raw: bytes) -> tuple[int, list[tuple[int, int, str, str]]]:
    """Number of words of a text, and (first word, words, label, kind) of each notice, in order of place."""
    automaton, _ = _automata()
    longest = max(len(p) for p in (*BASE, *NOTICES)) + 2
    out, n, tail, at = [], 0, " ", 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and raw[end] in _IS_WORD:  # a chunk ends where a word ends
            end += 1
        text = b" ".join(raw[at:end].translate(_WORD_BYTES).split()).decode("latin-1")
        at = end
        if not text:
            continue
        # The end of the chunk before goes in front, for notices over its edge; those that lie in it have been found.
        held = f"{tail}{text} "
        first, seen, spaces = n - tail.count(" ") + 1, 0, 0
        for stop, (size, label, kind) in automaton.iter(held):
            if stop >= len(tail):
                spaces += held.count(" ", seen, stop + 1)
                seen = stop + 1
                out.append((first + spaces - 1 - size, size, label, kind))
        n += text.count(" ") + 1
        tail = held[-longest:]
        tail = tail[tail.index(" ") :]
    return n, sorted(out)


def expressions(raw: bytes) -> list[tuple[int, str, int, list[str]]]:
    """(byte where the tag starts, expression, what it asks, labels) of each tag that an expression follows, in order of place."""
    _, automaton = _automata()
    longest, stops, text = max(map(len, TAGS)), {}, None
    for at in range(0, len(raw), CHUNK):
        begin = max(0, at - longest + 1)
        for stop, (size, loose) in automaton.iter(raw[begin : at + CHUNK].translate(_LOWER).decode("latin-1")):
            stops[begin + stop + 1 - size] = begin + stop + 1, loose
    out = []
    for start in sorted(stops):
        stop, loose = stops[start]
        text = raw.decode("latin-1") if text is None else text
        if loose and start and (text[start - 1].isalnum() or text[start - 1] in "-_"):
            continue
        if parts := tokens(text, loose, stop):
            out.append((start, *evaluate(parts)))
    return out


SPANS = "array<struct<word: long, n_words: long, label: string, kind: string>>"
TAGGED = "array<struct<byte: long, expression: string, asks: int, labels: array<string>>>"
SCHEMA = f"doc_id long, n_words long, notices {SPANS}, tags {TAGGED}, score double"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the notices and the tags with their expressions of every whole text, and score, the belief from 0 to 1 that
    the text states a licence.

    A null text is empty; an empty one has no words, no notices and score 0. Repeated rows give repeated results, a null doc_id
    stays null, no rows give none, and other columns are not looked at. An expression ends with its line or where its grammar
    ends.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            raw, bounds = utf8(batch)
            rows = [[], [], [], []]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                text = raw[a:b].tobytes()
                n, places = notices(text)
                tags = expressions(text)
                doubt = np.prod([1 - BELIEF[k] for *_, k in places] + [1 - BELIEF["tag"]] * len(tags))
                for own, x in zip(rows, (n, places, tags, 1.0 - float(doubt)), strict=True):
                    own.append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(rows[0], pa.int64()),
                    pa.array([[dict(zip(("word", "n_words", "label", "kind"), x, strict=True)) for x in r] for r in rows[1]], _SPANS),
                    pa.array([[dict(zip(("byte", "expression", "asks", "labels"), x, strict=True)) for x in r] for r in rows[2]], _TAGGED),
                    pa.array(rows[3], pa.float64()),
                ],
                names=["doc_id", "n_words", "notices", "tags", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


_SPANS = pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("kind", pa.string())]))
_TAGGED = pa.list_(pa.struct([("byte", pa.int64()), ("expression", pa.string()), ("asks", pa.int32()), ("labels", pa.list_(pa.string()))]))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and asks (the most of its tags) from scan's rows."""
    base = F.filter("notices", lambda x: x["kind"] == "base")
    words = F.transform(base, lambda x: x["word"])
    listed = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(x)))
    own = F.concat(F.transform("notices", lambda x: x["label"]), F.flatten(F.transform("tags", lambda x: x["labels"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        listed(F.transform(base, lambda x: x["label"])).alias("base_labels"),
        listed(own).alias("labels"),
        "score",
        F.array_max(F.transform("tags", lambda x: x["asks"])).alias("asks"),
    )
