"""Quality by compression: which of two dictionaries, of good or of bad text, compresses a text better.

zstandard trains a dictionary for each label on a bounded sample of labelled documents. A text is cut into
blocks of BLOCK bytes, so that the dictionary matters in long texts too; every block is compressed with
either dictionary. The difference of the sizes, by bytes of text, is the one feature of a logistic model,
fitted on labelled documents that neither dictionary has seen, weighted to the labels' true shares.

Defined cases: a null or empty text has the difference 0 and the score of that. Without labels of a
class its dictionary is empty; too few samples to train on become a dictionary of their own text.
Repeated rows, ties and null ids are rows like others; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis.llm.batches import per_batch, texts_of
from vacantis.llm.labelled import sample, shares

BLOCK, LEVEL, DICTIONARY_BYTES = 2048, 3, 1 << 16
# Labelled documents of each class: most of them make the dictionaries, the others fit the curve.
PER_CLASS, FOR_CURVE = 4000, 4
THRESHOLD = 0.5


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[str]) -> bytes:
    parts = [b for text in texts for b in blocks(text)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text
        return b"".join(parts)[:DICTIONARY_BYTES]


@lru_cache(maxsize=8)
def compressor(data: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(data) if data else None
    if held:
        held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def difference(text: str, good: bytes, bad: bytes) -> float:
    """Bytes saved by the good dictionary against the bad one, by byte of text."""
    by_good, by_bad = compressor(good), compressor(bad)
    parts = blocks(text)
    saved = sum(len(by_bad.compress(b)) - len(by_good.compress(b)) for b in parts)
    return saved / max(1, sum(map(len, parts)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a slight pull to 0."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + 1e-3 * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A model from labelled documents whose ``doc_id`` is ``allowed``."""
    rows = sample(docs, labels, label, allowed, per_class)
    share = shares(labels, label, allowed)
    for_curve = rows[::FOR_CURVE]
    for_dictionaries = [r for i, r in enumerate(rows) if i % FOR_CURVE]
    good, bad = (dictionary([t for t, y in for_dictionaries if y == c]) for c in (1, 0))
    x = np.array([difference(t, good, bad) for t, _ in for_curve])
    y = np.array([y for _, y in for_curve], float)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    return Model(good, bad, *(logistic(x, y, weight) if len(y) else (0.0, 0.0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the calibrated score of every whole text."""

    def work(batch: pa.RecordBatch) -> dict:
        x = np.array([difference(t, model.good, model.bad) for t in batch["text"].to_pylist()])
        z = np.clip(model.slope * x + model.intercept, -30, 30)
        return {"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-z))}

    return per_batch(texts_of(docs), work, "doc_id long, score double")
