"""Quality rules against counts in Python."""

import math
import re
from collections import Counter

import duckdb
import pytest
import xxhash

from vacantis.llm import quality_rules, queries

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(text):
    codes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    as_bytes = lambda c: (c & (1 << 64) - 1).to_bytes(8, "little")
    pairs = [signed(xxhash.xxh64_intdigest(as_bytes(b), xxhash.xxh64_intdigest(as_bytes(a), 42))) for a, b in zip(codes, codes[1:], strict=False)]
    return [c % quality_rules.BUCKETS for c in codes + pairs]


def expected_scores(rows, labels):
    raw, good = Counter(), Counter()
    for d, t in rows:
        b = buckets(t)
        raw.update(b)
        if labels.get(d) == 1:
            good.update(b)
    share = lambda c, n: (n + 1) / (c.total() + quality_rules.BUCKETS)
    w = {b: round(1e6 * math.log(share(good, good[b]) / share(raw, n))) for b, n in raw.items()}
    return {d: sum(w[x] for x in b) / 1e6 / max(1, len(b)) for d, b in ((d, buckets(t)) for d, t in rows)}


def test_given_table(spark, sf_dir, rows):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, sf_dir).collect()}
    scores = expected_scores(rows, labels)
    assert len(got) == len(rows)
    for d, t in rows:
        assert tuple(got[d][c] for c in BASE) == base(t)
        assert got[d].score == pytest.approx(scores[d], abs=1e-6)
        assert not (got[d].kept and got[d].base_failed)
    judged = [(got[d].kept, y) for d, y in labels.items() if not got[d].base_failed]
    assert sum(k == bool(y) for k, y in judged) >= 0.97 * len(judged)


@pytest.mark.parametrize("text", [
    "", "a", "a b", "a b c", "a b c a b c", "x x x x", "a b c d a b c d e a b c", " \t\x0b lead and trail \f\r\n",
    "l1\nl1\n\n \n \nl1 \nl2\nl2", "é é é é 日本 #|&<>%$*", "a\xa0b a\xa0b a\xa0b a\xa0b", "one two three\n" * 40,
])
def test_counts(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = quality_rules.measured(df, [0] * quality_rules.BUCKETS).first()
    assert tuple(r[c] for c in BASE) == base(text)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (9, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality_rules.judge(odd, labels).collect()
    assert Counter(r.n_words for r in got) == Counter(base(r.text)[0] for r in odd.collect())
    assert quality_rules.judge(none, labels).count() == 0
    alone = quality_rules.judge(odd, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in alone)


def test_native_plan(spark, odd):
    plan = quality_rules.measured(odd, [0] * quality_rules.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
