"""Personal data against the stated patterns; disclosure against counts made by hand."""

import hashlib
import math
import re
from collections import Counter

import pytest

from vacantis.llm import privacy, queries

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, *m.span()) for k, p in STATED.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


@pytest.mark.parametrize("text", [
    "a@b@c.com x@a.b@c.d .@x.y", "a.b+c%d@e-f.g.h. z@z z@z. @q.r", "1.2.3.4.5.6.7.8 1.2.3.256 01.002.3.4 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 11111111 1 4111111111111111", "+1 (377) 555-0271 +1-2 ++49 30 1234567) +1+4930123456",
    "é34@mail7.example.com日", "12345678901234567890 4111111111111111 -4111-1111-1111-1111-", "999.1.1.1 25.5.5.5x1.1.1.1",
])
def test_patterns(text):
    assert privacy.entities(text) == plain(text)


def test_long_runs_take_linear_time():
    for run in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000):
        privacy.entities(run)


def test_given_table(spark, sf_dir, rows):
    got = {r.doc_id: r for r in queries.op7_pii(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r, spans = got[doc_id], plain(text)
        text_of_spans = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert Counter(k for k, *_ in spans) == +Counter({k: r[f"n_{k}"] for k in STATED})
        assert r.base_sha256 == hashlib.sha256(text_of_spans.encode()).hexdigest()
        assert r.spans == text_of_spans or r.spans.startswith(text_of_spans + ",term:")
        assert spans or not r.spans
    assert any(r.spans for r in got.values())


def told(spark):
    """A term that stands near e-mail addresses only, one that does so half the time, a common one."""
    near = [(i, f"the secretword u{i}@x.org half the") for i in range(30)]
    far = [(100 + i, "the half " + " ".join(f"w{j}" for j in range(40))) for i in range(30)]
    return spark.createDataFrame([*near, *far, (None, None), (5, "")], "doc_id long, text string")


def test_disclosure(spark):
    docs = told(spark)
    found = privacy.find_entities(docs, "doc_id")
    got = {(r.kind, r.term): r.disclosure for r in privacy.disclosing_terms(docs, found).collect()}
    n_words = sum(len(privacy.WORD.findall(r.text or "")) for r in docs.collect())
    p = 30 * 4 / n_words
    assert got[("email", "secretword")] == pytest.approx(1.0)
    half = math.log(0.5 / p) / -math.log(p)
    assert (("email", "half") in got) == (half >= privacy.GENERALISE_AT)


def test_sanitised_text(spark):
    got = {r.doc_id: r.text for r in privacy.sanitise(told(spark)).collect()}
    assert got[1].startswith("[word] [removed] [email]")
    assert got[100] == "the half " + " ".join(f"w{j}" for j in range(40)) and got[None] is None


def test_rare_terms_disclose_at_every_size(spark):
    once = [(1, "write to zorblax a@b.co or wait"), (2, "write or wait to " + " ".join(f"w{j}" for j in range(60)))]
    found = []
    for times in (1, 4):
        docs = spark.createDataFrame(once * times, "doc_id long, text string")
        terms = privacy.disclosing_terms(docs, privacy.find_entities(docs, "doc_id")).collect()
        found.append({(r.kind, r.term): round(r.disclosure, 9) for r in terms})
    assert found[0] == found[1] and found[0]["email", "zorblax"] == 1.0
    assert "[removed]" in next(r.text for r in privacy.sanitise(docs).collect() if r.doc_id == 1)


def test_terms_go_wherever_they_stand_in_a_text_with_entities(spark):
    fill = " ".join(f"w{j}" for j in range(20))
    rows = [(i, f"zorblax a@b.co {fill}") for i in range(9)]
    rows += [(9, f"zorblax a@b.co {fill} Zorblax"), (10, f"x 1.2.3.4 {fill} zorblax"), (11, f"{fill} zorblax")]
    got = {r.doc_id: r.text for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "orblax" not in got[9] + got[10] and got[11] == rows[11][1]


def test_rewriting():
    text = "Call Anna on +1 377 555 0271 or a@b.co now"
    terms = [{"start": 5, "end": 9, "disclosure": 0.85}, {"start": 39, "end": 42, "disclosure": 1.0}]
    assert privacy.rewritten(text, privacy.rendered(privacy.entities(text)), terms) == "Call [name] on [phone] or [email] [removed]"


def test_odd_rows(spark, odd, none):
    got = privacy.sanitise(odd)
    assert got.schema.names == odd.schema.names
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, odd.collect()))
    assert privacy.annotate(odd).count() == odd.count()
    assert privacy.annotate(none).count() == 0 and privacy.sanitise(none).count() == 0
