"""Periodic runs against plain loops."""

import hashlib
import random
import zlib

from vacantis.llm import periodic, queries
from vacantis.llm.recompression import compress, extension

import numpy as np


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made_periodic(doc_id, text):
    words = text.encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest(words):
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    return len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_whole_table(spark, sf_dir, rows):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        assert got[doc_id] == digest(made_periodic(doc_id, text or "")), doc_id


def test_texts_of_few_words():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.randint(0, 120), rng.choice([1, 2, 3, 20])
            words = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
            texts.append(b"\t \n".join(words))
        runs, sizes, collapsed, ends = periodic.runs_of_texts(texts)
        at = 0
        for text, size, kept, end in zip(texts, sizes, collapsed, ends, strict=True):
            words = text.split()
            want = plain_runs(words)
            dropped = {i for s, n, q in want for i in range(s + q, s + n)}
            assert size == len(words) and [tuple(r) for r in runs[at:end].tolist()] == want
            assert kept == b" ".join(w for i, w in enumerate(words) if i not in dropped)
            at = end


def test_extensions():
    rng = np.random.default_rng(2)
    for k in (1, 2, 5):
        text = np.concatenate([[-1], np.tile(rng.integers(0, k, 37), 9), [-2], rng.integers(0, k, 300), [-3]])
        levels = compress(text, k)
        a, b = (rng.integers(1, len(text) - 1, 400) for _ in range(2))
        a, b = a[a != b], b[a != b]
        for step in (1, -1):
            for i, j, n in zip(a.tolist(), b.tolist(), extension(levels, a, b, step).tolist(), strict=True):
                want = 0
                while text[i + step * want] == text[j + step * want]:
                    want += 1
                assert n == want


def test_odd_rows(spark, odd, none):
    got = periodic.digests(periodic.periodic_runs(periodic.made_periodic(odd))).collect()
    rows = sorted((str(r.doc_id), digest(made_periodic(r.doc_id, r.text or ""))) for r in odd.collect() if len(r.text or "") < 1000 or r.text[0] == "x")
    long = "long " * 30_000
    words = made_periodic(9, long)
    whole = (1, 0, 30_000, 1, 30_000_000, hashlib.sha256(b"0,30000,1\n").hexdigest(), hashlib.sha256(b"long").hexdigest())
    assert words == long.encode().split()
    assert sorted((str(r.doc_id), tuple(r[c] for c in COLUMNS)) for r in got) == sorted([*rows, ("9", whole)])
    assert periodic.periodic_runs(none).count() == 0
