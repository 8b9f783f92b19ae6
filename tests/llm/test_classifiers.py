"""Toxicity and quality: held-out accuracy, whole texts, labels as the only teacher."""

import math
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from vacantis.llm import compression, queries, toxicity
from vacantis.llm.labelled import part_of, sample

LARGER = "/root/testdata/sf0.1"


def held_out(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


@pytest.mark.parametrize("query, label, parts, part, threshold, least", [
    (queries.op3_toxicity, "toxic", 4, 2, 0.3, 0.9),
    (queries.op8_compression_classifier, "quality", 3, 1, 0.5, 0.9),
])
def test_held_out(spark, query, label, parts, part, threshold, least):
    got = {r.doc_id: r for r in query(spark, LARGER).collect()}
    n = duckdb.sql(f"select count(*) from '{LARGER}/documents.parquet'").fetchall()[0][0]
    assert len(got) == n
    for r in got.values():
        assert r.held_out == held_out(r.doc_id, parts, part) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= threshold)
    truth = duckdb.sql(f"select doc_id, {label} from '{LARGER}/labels.parquet'").fetchall()
    right = [got[i].predicted == y for i, y in truth if got[i].held_out]
    assert len(right) > 50 and np.mean(right) >= least


@pytest.mark.parametrize("model", [toxicity, compression])
def test_odd_rows(spark, odd, none, model):
    labels = spark.createDataFrame([(3, 0, 1), (4, 1, 0), (8, 1, 0), (9, 0, 1), (0, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    fitted = model.fit(odd, labels, F.lit(True))
    got = model.score(odd, fitted).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r, o in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(odd.collect(), key=lambda r: str(r.doc_id)), strict=True):
        by_text.setdefault(o.text or "", set()).add(r.score)
    assert len(by_text[""]) == 1
    assert model.score(none, fitted).count() == 0
    unlabelled = model.fit(none, labels.limit(0), F.lit(True))
    assert len({r.score for r in model.score(odd, unlabelled).collect()}) == 1


def test_sample_is_bounded_and_fixed(spark, documents):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    allowed = part_of(F.col("doc_id"), 3) != 1
    first = sample(documents, labels, "quality", allowed, 20)
    again = sample(documents.repartition(5), labels.union(labels), "quality", allowed, 20)
    assert first == again and sorted(y for _, y in first) == [0] * 20 + [1] * 20


def test_thresholds_do_not_depend_on_the_cap(spark):
    """The cap takes most toxic and few clean documents; thresholds are for the mix of all of them."""
    draw = np.random.default_rng(3)
    steps = np.round(np.concatenate([draw.normal(-100, 100, 20_000), draw.normal(150, 100, 1_000)])).astype("i8")
    toxic = np.arange(len(steps)) >= 20_000
    at = lambda keep, taken: toxicity.thresholds_of(np.stack([0 * steps, steps, toxic, ~toxic], 1)[keep].astype("i8"), taken)[0]
    whole, some = at(steps == steps, np.array([0, 0])), at(~toxic | (draw.random(len(steps)) < 0.25), np.array([0, 750]))
    even = at(toxic | (draw.random(len(steps)) < 0.05), np.array([0, 0]))
    assert abs(whole - some) < 0.4 and whole - even > 0.5
    docs = spark.createDataFrame([(i, "foul word here" if i % 10 == 0 else "plain word here") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("label"))
    net = toxicity.fit(docs, labels, F.lit(True), "label", 20).network
    counts = toxicity.counted(docs, labels, net, list(range(30)))
    assert counts[:, 2].sum() == 37 and counts[:, 3].sum() == 333


def test_long_texts_count_whole():
    draw = np.random.default_rng(0)
    texts = [draw.integers(0, 1 << 18, (50, 2)) for _ in range(40)]
    marked = np.full((1, 2), 77)
    labels = np.array([i % 2 for i in range(40)], "f4")
    net = toxicity.train([np.concatenate([t, marked]) if y else t for t, y in zip(texts, labels, strict=True)], labels)
    long = draw.integers(0, 1 << 18, (2 * toxicity.STRETCH + 5, 2))
    plain, late = toxicity.logits(net, [long, np.concatenate([long, marked])])
    assert late > plain
    alone = toxicity.logits(net, [marked])[0]
    assert toxicity.logits(net, [texts[0], marked, texts[1]])[1] == pytest.approx(alone, abs=1e-4)


def test_windows_do_not_cross_texts():
    draw = np.random.default_rng(1)
    texts = [draw.integers(0, 50, (n, 2)) for n in (1, 0, 9, 3, 2)]
    labels = np.array([0, 1, 0, 1, 1], "f4")
    net = toxicity.train(texts * 4, np.tile(labels, 4))
    together = toxicity.logits(net, texts)
    apart = np.concatenate([toxicity.logits(net, [t]) for t in texts])
    assert together == pytest.approx(apart, abs=1e-4)


def test_block_difference_prefers_its_own_kind():
    good = [f"plain prose about the {w} of a quiet morning in the valley " * 6 for w in ("sound", "light", "course", "name") * 20]
    bad = [f"$$ {i} ## buy %% now && {i} << win >> " * 6 for i in range(80)]
    g, b = compression.dictionary(good), compression.dictionary(bad)
    assert compression.difference("prose about the light of a quiet morning", g, b) > 0 > compression.difference("## buy %% now &&", g, b)
    assert compression.difference("", g, b) == 0


def plain_logit(net, text):
    """The network in plain loops: every window of every filter, over the text and the padding behind it."""
    width = max(toxicity.WIDTHS)
    words, nothing = toxicity.WORD.findall(text.lower()), np.zeros(toxicity.DIMENSIONS)
    vectors = []
    for w in words:
        vector = nothing.copy()
        for k, part in enumerate((w, w[: toxicity.FIRST])):
            bucket = xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass")) >> 64 - toxicity.BUCKET_BITS
            vector += net.embeddings[net.rows[k][bucket]]
        vectors.append(vector)
    vectors += [nothing] * width
    total = net.offset
    for k, filters in enumerate(net.filters):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(words) + 1):
                value = float(net.bias[k][f])
                for j in range(len(filters)):
                    value += sum(float(vectors[at + j][d]) * float(filters[j][d][f]) for d in range(toxicity.DIMENSIONS))
                best = max(best, value)
            total += best * float(net.out[k][f])
    return total


def test_network_against_plain_loops(spark, documents, rows):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = toxicity.fit(documents, labels, F.lit(True), "label", 40)
    short = sorted((t for _, t in rows if t), key=len)[:25] + ["", "the der Le \u4e2d\u6587 don't", "\ud7ff_x_ 12"]
    found = toxicity.logits(model.network, [toxicity.buckets(t)[0] for t in short])
    assert found == pytest.approx([plain_logit(model.network, t) for t in short], abs=1e-3)
    tables = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(tables, model).collect()}
    order = sorted(range(len(short)), key=lambda i: (toxicity.buckets(short[i])[1], found[i]))
    for i, j in zip(order, order[1:], strict=False):  # within a language a score rises with the output
        if toxicity.buckets(short[i])[1] == toxicity.buckets(short[j])[1]:
            assert scores[i] <= scores[j] + 1e-9


def test_compression_against_plain_loop(spark, documents, rows):
    labels = documents.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = compression.fit(documents, labels, F.lit(True), per_class=40)
    packers = [
        zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        for d in (model.good, model.bad)
    ]
    got = {r.doc_id: r.score for r in compression.score(documents, model).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        data, saved = (text or "").encode(), 0
        for at in range(0, len(data), compression.BLOCK):
            good, bad = (len(p.compress(data[at : at + compression.BLOCK])) for p in packers)
            saved += bad - good
        z = model.slope * (saved / max(1, len(data))) + model.intercept
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-9)
