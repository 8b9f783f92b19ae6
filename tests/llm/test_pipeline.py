"""The pipeline, stage by stage, against brute force on each stage's own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_decontamination import brute as leaked
from test_jaccard import brute as near
from test_privacy import plain
from test_tokens import check_packing

import corpus_pipeline
from vacantis.llm import toxicity
from vacantis.llm.labelled import part_of
from vacantis.session import stored


@pytest.fixture(scope="module")
def stages(spark, documents, sf_dir):
    """Input and output rows of every stage."""
    docs, out = documents, []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf_dir), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.schema.names == documents.schema.names
        out.append((docs.collect(), after.collect()))
        docs = after
    return dict(zip((n for n, _ in corpus_pipeline.STAGES), out, strict=True))


def test_toxic_documents_go(spark, stages, documents, sf_dir):
    before, after = stages["toxicity"]
    model = toxicity.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), part_of(F.col("doc_id"), 4) != 2)
    scores = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    assert set(after) == {r for r in before if scores[r.doc_id] < toxicity.THRESHOLD} and len(after) < len(before)


def test_one_of_each_class_stays(stages):
    before, after = stages["ngram_jaccard_join"]
    classes = near([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(d for d, (c, _) in classes.items() if c == d)
    assert set(after) <= set(before) and len(after) < len(before)


def test_leaking_documents_go(stages, sf_dir, spark):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {d for d, _ in leaked([(r.doc_id, r.text) for r in before], items)}
    assert set(after) == {r for r in before if r.doc_id not in gone} and gone


def test_personal_data_is_gone_and_clean_texts_stay(stages):
    before, after = stages["pii"]
    texts = {r.doc_id: r for r in after}
    assert len(after) == len(before) == len(texts)
    for r in before:
        now = texts[r.doc_id]
        assert (now.lang, now.source, now.n_chars) == (r.lang, r.source, r.n_chars)
        if not plain(r.text):
            assert now == r
        else:
            assert not plain(now.text)


def test_all_that_is_left_is_packed(stages):
    before, after = stages["best_fit_packing"]
    n, least = check_packing(after, [(r.doc_id, r.text) for r in before], 2048)
    assert n <= 1.05 * least + 1


def test_run_is_the_stages(spark, stages, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()
    want = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages["best_fit_packing"][1]]
    assert Counter(map(tuple, got)) == Counter(want)


def test_odd_rows(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.schema.names == odd.schema.names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
