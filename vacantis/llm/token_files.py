"""Token ids in ORC files, in ascending document order.

Spark's ORC writer does the encoding: stripes, integer run-length encoding, row indexes and a Bloom
filter on ``doc_id``. Readers split files by stripe; a filter on ``doc_id`` skips files, stripes and
row groups by their statistics and Bloom filters.

Documents are dealt by range of ``doc_id`` and encoded once, in order; ``part`` numbers the files in
that order. A document's place among all ids is the place in its file plus the ids of earlier files,
of which there is one sum per file.

Defined cases: a null text counts as empty; every document ends with the end id, so an empty one
holds that id alone. A null ``doc_id`` comes first. Rows that share a ``doc_id`` are ordered by a hash
of their text; equal rows are interchangeable. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantis.llm.batches import in_arrow, per_batch, small, texts_of
from vacantis.llm.tokens import encoder

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
STRIPE_BYTES = 16 << 20
ROWS_PER_INDEX = 1_000
TABLE_BYTES = 256 << 20  # of known pieces in a Python worker, which holds little else here


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Write the ids of every document's whole text, and ``end_id``, to ORC files below ``path``."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in small(batches):
            ids, ends = encoder(tokenizer, TABLE_BYTES).encode(batch["text"].to_pylist(), end_id)
            sizes = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(np.full(len(ends), part, "i4")),
                    pa.array(at + ends - sizes),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(ids.view("<i4"))),
                ],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )
            at += int(ends[-1])

    tie = F.xxhash64("text")
    ordered = texts_of(docs).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    (
        in_arrow(ordered, encode, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", ROWS_PER_INDEX)
        .option("compression", "none")  # the run-length encoding packs the ids already
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; filters on ``doc_id`` reach the files' own metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def starts_of_parts(stored: DataFrame) -> DataFrame:
    """(part, first): ids in all earlier files. One row per file."""
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored document, from the files."""

    def checksums(batch: pa.RecordBatch) -> dict:
        lists = batch["ids"]
        values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
        return {
            "doc_id": batch["doc_id"],
            "part": batch["part"],
            "start_in_part": batch["start_in_part"],
            "n_tokens": np.diff(ends).astype("i8"),
            "ids_crc32": [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)],
        }

    stored = read_tokens(spark, path)
    rows = per_batch(
        stored.select("doc_id", "part", "start_in_part", "ids"),
        checksums,
        "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long",
    )
    # one row of 16 bytes per file: a million files make 16 MB
    return rows.join(F.broadcast(starts_of_parts(stored)), "part").select(
        "doc_id", (F.col("first") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
