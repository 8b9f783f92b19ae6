"""Decontamination against every window of every document, and the search against all fingerprints."""

import random
import re
from collections import Counter

from vacantis.llm import decontaminate, queries

DOCS, ITEMS = "doc_id long, text string, score double", "item_id long, text string"


def words(text):
    found = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in (text or "").lower().split()]
    return [w for w in found if w]


def grams(ws):
    return Counter({}) + Counter(" ".join(ws[i : i + 5]) for i in range(len(ws) - 4))


def similarity(a, b):
    size = lambda c: sum(n * (len(g) - 4) for g, n in c.items())
    return size(a & b) / max(1, size(a | b))


def brute(docs, items):
    found = {}
    texts = {(d, t) for d, t in docs}
    for item_id, item in items:
        b, n = grams(words(item)), len(words(item))
        if n < 5:
            continue
        for d, t in texts:
            ws = words(t)
            best = max((similarity(grams(ws[max(0, i) : i + n]), b) for i in range(-n + 5, len(ws) - 4)), default=0) if b.keys() & grams(ws).keys() else 0
            if best >= 0.8 - 1e-9:
                found[d, item_id] = round(best, 6)
    return found


def made():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(draw.randint(20, 50))).capitalize() + ".") for i in range(12)]
    items += [(50, "only four words here"), (51, None), (52, ""), (53, items[0][1])]
    docs = []
    for i in range(90):
        part = items[i % 12][1].split()
        kind = i % 6
        if kind == 1:  # one or two other words
            for _ in range(draw.randint(1, 2)):
                part[draw.randrange(len(part))] = word()
        if kind == 2:  # a half only
            part = part[: len(part) // 2]
        if kind == 3:  # a word left out, or put in
            at = draw.randrange(len(part))
            part = part[:at] + part[at + 1 :] if i % 2 else part[:at] + [word()] + part[at:]
        if kind == 4:
            part = [p.upper() + "," for p in part]
        if kind == 5:
            part = []
        before, after = ([word() for _ in range(draw.randint(0, 60))] for _ in (0, 1))
        docs.append((i, "  ".join([*before, *part, *after])))
    docs += [(200, items[3][1]), (201, " ".join(items[4][1].split()[1:])), (200, items[3][1]), (None, items[5][1])]
    return docs, items


def test_planted_items(spark):
    docs, items = made()
    df = spark.createDataFrame([(*d, 0.5) for d in docs], DOCS)
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in decontaminate.leaks(df, spark.createDataFrame(items, ITEMS)).collect()}
    want = brute(docs, items)
    # windows are laid by shared 5-grams only: the best of them may be one word off the best of all
    assert got.keys() <= want.keys() and len(want) > 40 and all(v <= want[k] for k, v in got.items())
    # fingerprints of pairs near the threshold can lie beyond the radius
    missed = {k: v for k, v in want.items() if k not in got}
    assert len(missed) <= 0.02 * len(want) and all(v < 0.9 for v in missed.values())
    kept = decontaminate.clean(df, spark.createDataFrame(items, ITEMS))
    leaking = {d for d, _ in got}
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in docs if d not in leaking)


def edited(draw, item, kind, word):
    """An item's words with one kind of edit."""
    part = item.split()
    if kind == "url":
        part[draw.randrange(len(part))] = "https://example.org/" + "x" * draw.randint(10, 40)
    elif kind == "number":
        part[draw.randrange(len(part))] = "9" * draw.randint(10, 30)
    elif kind == "cut":
        n = draw.randint(1, 4)
        part = part[n:] if draw.random() < 0.5 else part[:-n]
    elif kind == "halves":
        part = part[len(part) // 2 :] + part[: len(part) // 2]
    elif kind == "word":
        part[draw.randrange(len(part))] = word()
    return part


def test_edited_items(spark):
    """URLs, long numbers, cuts and swapped halves, alone and inside texts: found where the exact similarity passes."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklm") for _ in range(draw.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(draw.choice([40, 60, 80])))) for i in range(20)]
    docs = []
    for i in range(300):
        part = edited(draw, items[i % 20][1], ("url", "number", "cut", "halves", "word")[i // 20 % 5], word)
        before, after = ([word() for _ in range(draw.choice([0, 0, 30]))] for _ in (0, 1))
        docs.append((i, " ".join([*before, *part, *after])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame([(*d, 0.5) for d in docs], DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = brute(docs, items)
    assert got <= want.keys() and len(want) > 200
    assert len(got) >= 0.98 * len(want)
    halves = {k for k in want if k[0] // 20 % 5 == 3}
    assert len(halves) > 40 and len(halves & got) >= 0.95 * len(halves)
    print("recall", len(got), len(want))


def test_clean_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "x"), (2, "other words", "y")], "doc_id long, text string, leaking string")
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, "a b c d e f g h")], ITEMS)).collect()
    assert [(r.doc_id, r.leaking) for r in kept] == [(2, "y")]


def test_given_table(spark, sf_dir, rows):
    import pyarrow.parquet as pq

    items = [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in queries.op6_decontamination(spark, sf_dir).collect()}
    assert got == brute(rows, items)


def test_search_finds_all_within_the_radius(spark):
    draw = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(i, 30, draw.getrandbits(64)) for i in range(20)]
    prints = []
    for i in range(400):
        x = items[i % 20][2]
        for b in draw.sample(range(64), i % 24):
            x ^= 1 << b
        prints.append((i, 0, 30, x))
    found = decontaminate.candidates(
        spark.createDataFrame([(*p[:3], signed(p[3])) for p in prints], "doc long, first int, n int, print long"),
        spark.createDataFrame([(*i[:2], signed(i[2])) for i in items], "item long, n int, print long"),
    )
    got = {(r.doc, r.item) for r in found.collect()}
    assert got == {(p[0], i[0]) for p in prints for i in items if (p[3] ^ i[2]).bit_count() <= decontaminate.RADIUS}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the same text of more than five words"), (3, "long " * 9)], ITEMS)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect()}
    assert got == {(4, 3), (5, 3), (9, 3)}
    kept = decontaminate.clean(odd, items)
    assert kept.schema.names == odd.schema.names and kept.count() == odd.count() - 4
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.clean(none, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0 and decontaminate.clean(odd, items.limit(0)).count() == odd.count()


def test_native_plan(spark, documents, sf_dir):
    plan = queries.op6_decontamination(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_small_files_are_no_reason_to_broadcast(spark, monkeypatch):
    docs, items = made()
    docs, items = spark.createDataFrame([(*d[:2], 0.0) for d in docs], DOCS), spark.createDataFrame(items, ITEMS)
    want = sorted(map(repr, decontaminate.leaks(docs, items).collect()))
    plans, keep = [], decontaminate.stored

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, label)

    monkeypatch.setattr(decontaminate, "stored", seen)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    found = decontaminate.leaks(docs, items)
    for label, df in (("leaks", found), ("clean", decontaminate.clean(docs, items))):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
    assert want and sorted(map(repr, found.collect())) == want
    assert [label for label, plan in plans if "Broadcast" in plan] == []
