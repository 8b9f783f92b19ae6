"""Language identification: held-out accuracy, and plain loops over a small corpus."""

import math
import zlib
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vacantis.llm import language, queries


def letters(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain(train, texts):
    """Predictions by the stated rule, without bounds of the model."""
    words, grams, docs = Counter(), Counter(), Counter()
    for lang, text in train:
        docs[lang] += 1
        for w in letters(text):
            words[lang, w] += 1
            padded = f" {w} "
            for n in range(1, 5):
                for i in range(len(padded) - n + 1):
                    if padded[i : i + n] != " ":
                        grams[lang, padded[i : i + n]] += 1
    langs = sorted(docs)
    known_words, known_grams = {w for _, w in words}, {g for _, g in grams}

    def log_frequency(counts, names, key, lang, size=None):
        same = [x for x in names if size is None or len(x) == size]
        total = sum(n for (la, x), n in counts.items() if la == lang and (size is None or len(x) == size))
        return math.log(counts[lang, key] + 0.5) - math.log(total + 0.5 * len(same) + 1e-9)

    out = []
    for text in texts:
        found = letters(text)
        if not found:
            out.append("und")
            continue
        sums = {la: math.log(docs[la] / sum(docs.values())) for la in langs}
        for w in found:
            for la in langs:
                if w in known_words:
                    sums[la] += log_frequency(words, known_words, w, la)
                    continue
                padded = f" {w} "
                for i in range(len(padded)):
                    size = next((n for n in (4, 3, 2, 1) if padded[i : i + n] in known_grams and len(padded[i : i + n]) == n), 0)
                    if size:
                        sums[la] += log_frequency(grams, known_grams, padded[i : i + size], la, size) / size
        out.append(max(langs, key=lambda la: (round(sums[la], 4), docs[la])))
    return out


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in pq.read_table(f"{d}/documents.parquet").to_pylist()}
    got = queries.op12_language_id(spark, d).collect()
    assert len(got) == len(truth)
    held_out = [r for r in got if r.held_out]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id][1] or ""))
    right = [r.lang_pred == truth[r.doc_id][0] for r in held_out if r.lang_pred != "und"]
    assert len(right) > 1000 and sum(right) / len(right) > 0.99


def test_against_plain_loops(spark, documents):
    rows = documents.select("doc_id", "lang", F.substring("text", 1, 120).alias("text")).orderBy("doc_id").limit(40).collect()
    df = spark.createDataFrame(rows)
    model = language.fit(df, F.col("doc_id") % 2 == 0)
    ordered = sorted(rows, key=lambda r: r.doc_id)
    want = plain([(r.lang, r.text) for r in ordered if r.doc_id % 2 == 0 and r.lang], [r.text for r in ordered])
    got = {r.doc_id: r.lang_pred for r in language.identify(df, model).collect()}
    assert [got[r.doc_id] for r in ordered] == want


def test_odd_rows(spark, odd, none):
    model = language.fit(odd, F.lit(True))
    assert model.languages == ["en"]
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert len(got) == odd.select("doc_id").distinct().count()
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[3].lang_pred == "en" and got[0].score == 0
    unlearned = language.fit(none, F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, unlearned).collect()} == {"und"}
    assert language.identify(none, model).count() == 0
    # without known letters the more frequent language
    two = spark.createDataFrame([(1, "aa bb", "x"), (2, "cc", "x"), (3, "dd", "y")], "doc_id long, text string, lang string")
    got = language.identify(spark.createDataFrame([(1, "ЖЖ"), (2, "Ddd 1"), (3, "12 _ ²")], "doc_id long, text string"), language.fit(two, F.lit(True)))
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "x", 2: "y", 3: "und"}


def test_bound_of_the_model(spark):
    counts = spark.createDataFrame([("x", w, n) for w, n in [("a", 5), ("b", 3), ("c", 3), ("d", 1)]] + [("y", "d", 3)], "lang string, word string, n long")
    kept = lambda most: {r.word for r in language.frequent(counts, "word", most).collect()}
    assert kept(4) == {"a", "b", "c", "d"} and kept(3) == {"a", "d"} and kept(2) == {"a", "d"} and kept(0) == set()
