"""URL filters: stated rules URL by URL, mined rules against all combinations of a small table."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from vacantis.llm import queries, url_rules

STATED = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(host, path):
    fits = [r for r in STATED if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no-scheme.com/en/", "http://", "http://com/", "http://COM", "https://Example.com/en/", "https://example.com/en",
    "https://www.example.com/en/x?y#z", "https://a.www.example.com/en/", "https://notexample.com/en/1", "http://x.net/es/?q", "http://net/fr/",
    "http://x.net?/fr/", "http://x.net#/es/", "ftp://a://b.com/", "http://É.com/ü", "http://x.com\n/en/",
]


def test_hosts_paths_and_stated_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, blocked boolean")
    for r in url_rules.judge(pages, none).collect():
        assert (r.host, r.path) == parts(URLS[r.page_id])
        assert r.rule == rule(r.host, r.path)
        assert r.verdict == STATED.get(r.rule, "allow") or r.confidence is not None


def test_given_table(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = queries.op10_url_filters(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert (r.host, r.path) == parts(pages[r.page_id]) and r.rule == rule(r.host, r.path)
        assert r.verdict == STATED[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_mined_rules_are_all_and_only_the_surest(spark):
    draw = random.Random(8)
    rows = []
    for _ in range(400):
        held = sorted({draw.choice("abcdef") for _ in range(4)})
        bad = {"a", "b"} <= set(held) or draw.random() < 0.05
        rows.append((held, "block" if bad else "allow"))
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r.antecedent), r.verdict): r for r in url_rules.mine(labelled, 0.05, 0.8).collect()}
    n, both = Counter(), Counter()
    for held, verdict in rows:
        for k in range(1, len(held) + 1):
            for some in combinations(held, k):
                n[some] += 1
                both[some, verdict] += 1
    sure = {(s, v): c / n[s] for (s, v), c in both.items() if c >= 0.05 * len(rows) and c / n[s] >= 0.8}
    want = {k for k, c in sure.items() if not any(sure.get((s, k[1]), 0) >= c for m in range(1, len(k[0])) for s in combinations(k[0], m))}
    assert set(got) == want and (("a", "b"), "block") in got
    single = Counter(t for held, _ in rows for t in held)
    for (some, verdict), r in got.items():
        assert r.confidence == pytest.approx(sure[some, verdict])
        assert (single[r.token], r.token) == min((single[t], t) for t in some)


def test_matching_by_index(spark):
    rules = spark.createDataFrame(
        [(["a", "b"], "block", 0.9, "b"), (["c"], "allow", 0.95, "c"), (["a", "d"], "allow", 0.9, "d")],
        "antecedent array<string>, verdict string, confidence double, token string",
    )
    urls = spark.createDataFrame([("u1", ["a", "b"]), ("u2", ["a", "b", "c"]), ("u3", ["b"]), ("u4", ["a", "b", "d"]), (None, [])], "url string, tokens array<string>")
    got = {r.url: r.mined for r in url_rules.mined_verdicts(urls, rules).collect()}
    assert got == {"u1": "block", "u2": "allow", "u4": "block"}


def test_a_hot_long_url_ends(spark):
    hot = "http://hot.org/" + "/".join(f"part{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)) + "?q=1"
    rows = [(i, hot) for i in range(60)] + [(60 + i, f"http://h{i % 7}.org/{'bad' if i % 2 else 'good'}/p{i}x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 60 or i % 2 == 1) for i, _ in rows], "page_id long, blocked boolean")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels, min_support=0.05).collect()}
    assert all(got[i] == "block" for i in range(60)) and [got[60 + i] for i in range(4)] == ["allow", "block"] * 2


def test_planted_rule_reaches_unlabelled_pages(spark):
    rows = [(i, f"http://site{i % 9}.org/{('casino', 'news')[i % 2]}/x{i}y") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(0, 200)], "page_id long, blocked boolean")
    for r in url_rules.judge(pages, labels).collect():
        assert r.verdict == ("block" if r.page_id % 2 == 0 else "allow") and r.confidence is not None


def test_odd_rows(spark):
    rows = [(i, u, "x", 1.0) for i, u in enumerate(URLS)] + [(None, "http://x.org/a", "x", 1.0)] * 3 + [(5, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, confidence double")
    labels = spark.createDataFrame([(1, True), (1, False), (None, True), (2, None)], "page_id long, blocked boolean")
    assert url_rules.judge(pages, labels).count() == len(rows)
    assert url_rules.judge(pages.limit(0), labels).count() == 0
