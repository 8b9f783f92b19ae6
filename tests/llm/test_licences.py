"""Licence scans against the stated words, phrase by phrase."""

import re

import pytest

from vacantis.llm import licences, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_given_table(spark, sf_dir, rows):
    got = {r.doc_id: r for r in queries.op4_license_scans(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1
    assert any(r.base_labels for r in got.values())


@pytest.mark.parametrize("text", [
    "", " \n", "cc by cc by", "CC-BY cc  by, ccby accby cc by", "All rights\nreserved general public license",
    "GNU General Public Licensed", "all all rights reserved all rights", "É cc by é \xa0 cc\xa0by",
    "general public license cc by all rights reserved cc by",
])
def test_base_places(text):
    assert licences.scan(text)[:5] == base(text)


@pytest.mark.parametrize("expression, labels, value", [
    ("MIT", {"mit"}, 1.0),
    ("MIT OR GPL-3.0-only AND CC-BY-NC-4.0", {"mit", "gpl", "cc-by-nc"}, 1.0),
    ("(MIT OR GPL-3.0-only) AND CC-BY-NC-4.0", {"mit", "gpl", "cc-by-nc"}, 0.2),
    ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl"}, pytest.approx(0.6)),
    ("mit and (apache-2.0 or (agpl-3.0 and bsd-3-clause))", {"mit", "apache", "agpl", "bsd"}, 1.0),
])
def test_expressions(expression, labels, value):
    assert licences.evaluate(expression) == (labels, value)


@pytest.mark.parametrize("expression", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT GPL-3.0", "nothing-known", "MIT WITH GPL OR", "()"])
def test_malformed_expressions(expression):
    assert licences.evaluate(expression) is None


def test_tags_in_text():
    text = "# SPDX-License-Identifier: (Apache-2.0 OR MIT)\n# SPDX-License-Identifier: what ever\nx"
    assert licences.scan(text)[5] == "apache,mit,unknown-expression"
    assert licences.scan("Licensed under the Apache License, Version 2.0.")[5:] == ("apache", 1.0)


@pytest.mark.parametrize("text, labels", [
    ("licensed under a clear sky. SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0", "gpl,mit"),
    ("SPDX-License-Identifier: LGPL-3.0-only WITH LGPL-3.0-linking-exception", "lgpl"),
    ("SPDX-License-Identifier: MIT this file is short", "mit"), ("SPDX-License-Identifier: MIT.", "mit"),
    ("SPDX-License-Identifier: MIT OR", "mit"), ("SPDX-License-Identifier: (MIT OR ISC", "unknown-expression"),
    ("SPDX-License-Identifier: MIT AND (ISC OR", "mit"), ("SPDX-License-Identifier: x AND MIT", "unknown-expression"),
    ("License-Expression: mit with\nSPDX License Identifier: isc", "isc,mit"), ("SPDX-License-Identifier:", "unknown-expression"),
])
def test_every_tag_of_a_line(text, labels):
    assert licences.scan(text)[5] == labels


def test_a_long_expression_is_read_once():
    assert licences.scan("SPDX-License-Identifier: " + "(MIT AND ISC) OR " * 50_000 + "x")[5:] == ("isc,mit", 1.0)


def test_odd_rows(spark, odd, none):
    got = licences.scan_licences(odd).collect()
    assert sorted((r.n_words, r.n_base) for r in got) == sorted(base(r.text)[:2] for r in odd.collect())
    assert licences.scan_licences(none).count() == 0
