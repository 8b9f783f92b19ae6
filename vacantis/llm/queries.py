"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from vacantis.llm import (
    compression, conversations, decontaminate, jaccard, language, licences, packing, periodic, privacy, quality_rules, token_files,
    toxicity, url_rules,
)
from vacantis.llm.labelled import judged, part_of
from vacantis.session import fresh_folder


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.judge(given(spark, d, "documents"), given(spark, d, "labels"))


def op2_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    # nothing else is held here, unlike in the pipeline
    return packing.pack(given(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), table_bytes=token_files.TABLE_BYTES)


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, part = given(spark, d, "documents"), part_of(F.col("doc_id"), 4)
    model = toxicity.fit(docs, given(spark, d, "labels"), part != 2)
    return judged(toxicity.score(docs, model), part == 2, toxicity.THRESHOLD)


def op4_license_scans(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan_licences(given(spark, d, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.join(given(spark, d, "documents"))


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.leaks(given(spark, d, "documents"), given(spark, d, "benchmark"))


def op7_pii(spark: SparkSession, d: str) -> DataFrame:
    return privacy.annotate(given(spark, d, "documents"))


def op8_compression_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs, part = given(spark, d, "documents"), part_of(F.col("doc_id"), 3)
    model = compression.fit(docs, given(spark, d, "labels"), part != 1)
    return judged(compression.score(docs, model), part == 1, compression.THRESHOLD)


def op9_token_files(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark, "token-files")
    token_files.write_tokens(given(spark, d, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.digests(spark, path)


def op10_url_filters(spark: SparkSession, d: str) -> DataFrame:
    # pages are labelled by the document of the same number
    labels = given(spark, d, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")
    )
    return url_rules.judge(given(spark, d, "pages"), labels)


def op11_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    given_rows = given(spark, d, "conversations")
    return conversations.audit(conversations.damaged(given_rows), given_rows)


def op12_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs, part = given(spark, d, "documents"), part_of(F.col("doc_id"), 5)
    return language.identify(docs, language.fit(docs, part != 0)).select(
        "doc_id", F.coalesce(part_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.made_periodic(given(spark, d, "documents"))))


def queries() -> dict:
    found = (
        op1_quality_rules, op2_best_fit_packing, op3_toxicity, op4_license_scans, op5_ngram_jaccard_join, op6_decontamination, op7_pii,
        op8_compression_classifier, op9_token_files, op10_url_filters, op11_conversation_repair, op12_language_id, op13_periodic_runs,
    )
    return {q.__name__: q for q in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """None: the methods (hashes, trained models, tokenizers, mined rules) are beyond SQL on whole tables."""
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
