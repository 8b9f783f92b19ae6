"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longer texts are scored like all others but not used to fit a model, so that a sample's size is bounded.
MOST_CHARS = 100_000


def part_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def known(labels: DataFrame, label: str, allowed: Column) -> DataFrame:
    """(doc_id, label) of the ``allowed`` labelled ids; contradicting labels count as the higher."""
    return (
        labels.select("doc_id", F.col(label).alias("label"))
        .filter(F.col("label").isin(0, 1) & allowed)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most ``per_class`` documents of each class, in a fixed pseudo-random order.

    ``allowed`` is a condition on ``doc_id``. A document with contradicting labels counts as the higher;
    of rows that share a ``doc_id`` one is taken. Null texts, ids and labels are passed over.
    """
    order = F.xxhash64("doc_id")
    of_class = known(labels, label, allowed)
    first = [of_class.filter(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    picked = F.broadcast(first[0].union(first[1]))  # at most 2 x per_class rows
    texts = docs.select("doc_id", "text").filter(F.length("text") <= MOST_CHARS)
    rows = texts.join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return [(r["doc_id"], r["text"], r["label"]) for r in rows.orderBy(order, "doc_id").collect()]


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int) -> list[tuple[str, int]]:
    """(text, label) of ``sample_rows``."""
    return [(t, y) for _, t, y in sample_rows(docs, labels, label, allowed, per_class)]


def shares(labels: DataFrame, label: str, allowed: Column) -> float:
    """The share of label 1 among all allowed labels, drawn slightly to a half."""
    n, ones = labels.filter(F.col(label).isin(0, 1) & allowed).agg(F.count("*"), F.sum(label)).first()
    return ((ones or 0) + 1) / (n + 2)


def judged(scored: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    """held_out and predicted beside the score."""
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *[c for c in scored.columns if c not in ("doc_id", "score")],
    )
