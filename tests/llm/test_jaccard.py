"""The Jaccard join against all pairs of a small fixture, and its parts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vacantis.llm import jaccard, queries, shingles
from vacantis.llm.components import components


def shingle_set(text):
    import re

    words = re.findall(r"[^\W_]+", (text or "").lower())
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(rows):
    """doc_id: (class_id, n_links) by comparing all pairs of distinct sets."""
    members = defaultdict(list)
    for doc_id, text in rows:
        members[shingle_set(text)].append(doc_id)
    nodes = [s for s in members if s]
    links, root = Counter(), {s: s for s in nodes}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if len(a) * 0.8 <= len(b) <= len(a) / 0.8 and len(a & b) >= 0.8 * len(a | b):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for s in nodes:
        r = find(s)
        least[r] = min([*members[s], *([least[r]] if r in least else [])])
    return {d: (least[find(s)], links[s]) if s else (d, 0) for s, ds in members.items() for d in ds}


def near_copies(n, seed=2):
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 9])):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    return rows + [(n + i, " ".join(f"y{draw.randint(0, 10**6)}" for _ in range(50))) for i in range(40)]


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(df, **more).collect()}


def test_given_table(spark, sf_dir, rows):
    found = {r.doc_id: (r.class_id, r.n_links) for r in queries.op5_ngram_jaccard_join(spark, sf_dir).collect()}
    assert found == brute(rows)


@pytest.mark.parametrize("block", [16, 256])
def test_group_of_near_copies_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(90)
    assert got(spark, rows, recall=0.999999) == brute(rows)


def test_links_count_texts(spark):
    """Texts that differ in case or punctuation have one set, and are still different texts."""
    near = [f"w{i}" for i in range(60)]
    texts = [" ".join(near), " ".join(near).upper(), ", ".join(near), " ".join([*near[:-1], "other"]), "short text", "Short, text!", "alone here"]
    rows = [*enumerate(texts), (7, texts[0]), (8, None), (9, "...")]  # an equal text, and texts without words
    want = {}
    for d, t in rows:
        a = shingle_set(t)
        want[d] = sum(len(a & shingle_set(u)) >= 0.8 * len(a | shingle_set(u)) for u in {u for _, u in rows} - {t} if shingle_set(u)) if a else 0
    assert want == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1, 6: 0, 7: 3, 8: 0, 9: 0}
    assert {d: n for d, (_, n) in got(spark, rows).items()} == want


def test_odd_rows(spark, odd, none):
    found = jaccard.join(odd).collect()
    assert len(found) == odd.count()
    by_id = defaultdict(set)
    for r in found:
        by_id[r.doc_id].add((r.class_id, r.n_links))
    assert by_id[4] == by_id[5] == {(4, 0)} and by_id[0] == {(0, 0)} and by_id[None] == {(None, 0)}
    assert jaccard.join(none).count() == 0 and jaccard.keep_one(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.schema.names == odd.schema.names
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]


def test_keep_one_of_each_class(spark, sf_dir, rows, documents):
    kept = [r.doc_id for r in jaccard.keep_one(documents).collect()]
    assert sorted(kept) == sorted(d for d, (c, _) in brute(rows).items() if d == c)


def test_two_rows_without_id_stay_apart(spark):
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven")]
    assert jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_common_sizes():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 300, n)) for n in (1, 50, 200, 90, 400)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert jaccard.common(sets).tolist() == want
    assert jaccard.common(sets[:2]).tolist() == [r[:2] for r in want[:2]]


def test_bands_reach_the_recall():
    bands, rows = shingles.choose_bands(0.8, 0.9995, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995
    draw = np.random.default_rng(9)
    hit = 0
    for _ in range(200):
        both = draw.integers(0, 1 << 63, 160, "u8")
        own = draw.integers(0, 1 << 63, 40, "u8")
        a, b = np.unique(np.append(both, own[:20])), np.unique(np.append(both, own[20:]))
        hit += bool((shingles.band_hashes([a], bands, rows) == shingles.band_hashes([b], bands, rows)).any())
    assert hit >= 198


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 100)] + [(500, 501)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {0, 500} and found[102] == 0 and found[501] == 500


def test_compare_counts_a_pair_in_its_first_band():
    sets = [list(range(100)), list(range(99)), list(range(1000, 1100))]
    table = pa.table({
        "hi": pa.array([1, 2, 3]), "lo": pa.array([0, 0, 0]), "block": pa.array([0, 0, 0], pa.int32()),
        "own": pa.array(sets), "kept_bands": pa.array([[5, 9], [5, 9], [9]]),
    })
    first, second = (jaccard.compare(tuple(map(pa.scalar, (b, 0, 0))), table, 0.8).to_pylist() for b in (5, 9))
    assert [(r["hi"], r["n"], r["to_hi"]) for r in first] == [(1, 1, 1), (2, 1, 1)] and second == []


def test_minus_one_and_no_id_are_different_rows(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(-1, text), (None, text), (-1, text)], "doc_id long, text string")
    assert jaccard.keep_one(docs).count() == 1
