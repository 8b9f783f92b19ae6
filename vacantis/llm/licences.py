"""Licence notices and identifier tags in whole texts.

A text is lower-cased (A-Z) and cut into words; an Aho-Corasick automaton over the words, joined by
single blanks, finds every place of every phrase in one pass. Some phrases are tags: what follows them
on their line is read as a licence expression, which a shunting-yard parser evaluates:
``with`` binds closest, then ``and``, then ``or``.

The score says how freely a text may be used: 1 freely, 0 not at all, 0.5 without a sign. A licence
expression takes the largest value of alternatives and the smallest of joint terms; an exception raises
a term by EXCEPTION_GAIN. A text takes the smallest of its findings.

An expression ends where its line or the next tag begins, and is read as far as it is well formed and names
known licences ("MIT this file" is MIT). What follows ``with`` is an exception, whatever it is called.

Defined cases: a null or empty text has no words and no labels. A tag without an expression that begins with a known licence
gives the label ``unknown-expression`` and does not count for the score.
Repeated rows, ties and null ids are rows like others; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from vacantis.llm.batches import per_batch, texts_of

# Phrases that the base columns count.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further phrases, with their labels.
PHRASES = {
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc0": "cc0", "public domain": "public-domain",
    "creative commons": "cc", "apache license": "apache", "mit license": "mit", "bsd license": "bsd",
    "isc license": "isc", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "boost software license": "bsl", "the unlicense": "unlicense", "proprietary and confidential": "reserved",
}

# Tags before an expression; the last also opens ordinary sentences.
TAGS = ("spdx license identifier", "license expression", "licensed under")

# How freely works under a label may be used.
FREEDOM = {
    "cc-by": 0.9, "gpl": 0.4, "reserved": 0.0, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-sa": 0.6, "cc0": 1.0,
    "public-domain": 1.0, "cc": 0.6, "apache": 1.0, "mit": 1.0, "bsd": 1.0, "isc": 1.0, "mpl": 0.7, "epl": 0.7,
    "lgpl": 0.6, "agpl": 0.3, "bsl": 1.0, "unlicense": 1.0,
}
NO_SIGN, EXCEPTION_GAIN = 0.5, 0.2

# An identifier belongs to the label that its name starts with; longer names first.
STEMS = sorted(set(FREEDOM) - {"reserved", "public-domain"}, key=lambda x: (-len(x), x))
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
PART = re.compile(r"[()]|[a-z0-9.+-]+")
SPOKEN = re.compile(r"[(a-z0-9][a-z0-9.+() -]*")

# ASCII letters and digits in lower case, other ASCII as blanks, the rest as it is.
LOWER = bytes(ord(c.lower()) if (c := chr(i)).isascii() and c.isalnum() else 32 if i < 128 else i for i in range(256))


def label_of(identifier: str) -> str | None:
    return next((s for s in STEMS if identifier == s or identifier.startswith((s + "-", s + "+"))), None)


def postfix(expression: str) -> list[str] | None:
    """Shunting yard: the expression with operators behind their operands; None if malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether an operand has just ended
    for part in PART.findall(expression.lower()):
        if part in PRECEDENCE or part == ")":
            if not operand:
                return None
            least = PRECEDENCE.get(part, 0)
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= least:
                out.append(waiting.pop())
            if part == ")":
                if not waiting:
                    return None
                waiting.pop()
            else:
                waiting.append(part)
                operand = False
        elif operand:
            return None
        elif part == "(":
            waiting.append(part)
        else:
            out.append(part)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels and freedom of an expression; None if malformed or with an unknown licence."""
    parts = postfix(expression)
    held: list[tuple[set[str], float | None, str]] = []  # an exception has no value of its own
    for part in parts or ():
        if part not in PRECEDENCE:
            label = label_of(part)
            held.append(({label} if label else set(), FREEDOM.get(label), part))
            continue
        (left, a, name), (right, b, _) = held[-2], held[-1]
        del held[-2:]
        if a is None or (b is None and part != "with"):
            return None
        if part == "with":
            held.append((left, min(1.0, a + EXCEPTION_GAIN), name))
        else:
            held.append((left | right, max(a, b) if part == "or" else min(a, b), name))
    return held[0][:2] if held and held[0][1] is not None else None


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in [*BASE, *PHRASES, *TAGS]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def tag_places() -> re.Pattern[str]:
    """A tag as it is written."""
    spelt = "|".join("[^a-z0-9\n]+".join(tag.split()) for tag in TAGS)
    return re.compile(rf"(?:^|(?<=[^a-z0-9]))(?:{spelt})(?=[:\s])")


def beginning(parts: list[str]) -> list[str]:
    """The longest beginning that is a well-formed expression of known licences."""
    end = depth = 0
    operand = exception = False
    for i, part in enumerate(parts):
        if part in PRECEDENCE:
            if not operand:
                break
            operand, exception = False, part == "with"
            continue
        if part == "(":
            if operand or exception:
                break
            depth += 1
            continue
        if part == ")":
            if not (operand and depth):
                break
            depth -= 1
        elif operand or not (exception or label_of(part)):
            break
        operand, exception = True, False
        if not depth:
            end = i + 1
    return parts[:end]


def expressions(text: str) -> list[tuple[set[str], float]]:
    """What the tags of a text say, in order. Prose after "licensed under" is no faulty expression."""
    found = []
    places = list(tag_places().finditer(text))
    for m, after in zip(places, [*[x.start() for x in places[1:]], len(text)], strict=True):
        rest = SPOKEN.match(text[m.end() : after].split("\n", 1)[0].strip(" \t:*/#-"))
        parts = [p for x in PART.findall(rest[0]) if (p := x.rstrip(".-") or x)] if rest else []
        value = evaluate(" ".join(beginning(parts)))
        if value:
            found.append(value)
        elif not m[0].startswith("licensed"):
            found.append(({"unknown-expression"}, None))
    return found


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    padded = b" ".join([b"", *words, b""]).decode("latin-1")
    starts, base, labels, tagged = [], set(), set(), False
    at = word = 0
    values = []
    for end, phrase in automaton().iter(padded):
        if phrase in BASE:
            start = end - len(phrase) - 1
            # ends come in order, starts may step back by one phrase
            word += padded.count(" ", at, start) if start >= at else -padded.count(" ", start, at)
            at = start
            starts.append(word)
            base.add(BASE[phrase])
        elif phrase in PHRASES:
            labels.add(PHRASES[phrase])
        else:
            tagged = True
    labels |= base
    values += [FREEDOM[x] for x in labels]
    if tagged:
        for named, value in expressions(text.lower()):
            labels |= named
            if value is not None:
                values.append(value)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), min(values, default=NO_SIGN),
    )


FOUND = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id and the findings of every whole text."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = [scan(text) for text in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"]} | dict(zip(FOUND, zip(*rows, strict=True), strict=True))

    return per_batch(
        texts_of(docs), work,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
