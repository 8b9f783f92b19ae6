"""Arrow batches in and out of Python tasks."""

from __future__ import annotations

import ctypes
import os
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Rows and bytes of text that are worked on together; only memory depends on them.
ROWS, TEXT_BYTES = 2048, 2 << 20
# Rows that Spark hands over at once; its default of 10,000 is for numbers, not for whole texts.
HANDED_OVER, SETTING = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"


_table: dict[str, object] = {}


def worker_table(name: str, make: Callable[[], object]):
    """A table that this Python process keeps between tasks; asking for another one drops it.

    So a worker that serves one operator after the other holds the table of one only.
    """
    if name not in _table:
        _table.clear()
        _table[name] = make()
    return _table[name]


@lru_cache(maxsize=1)
def _ship(application: str) -> None:
    """Send this package's modules to the Python workers, once per application."""
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(SparkFiles.getRootDirectory(), "vacantis_modules.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, str(module.relative_to(package.parent)))
    SparkContext.getOrCreate().addPyFile(archive)


def give_back() -> None:
    """Return memory that is free in this process to the system; a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package's modules at hand in the workers, which return memory when a task ends.

    The session's Arrow batches are made smaller (to HANDED_OVER rows) unless they are so already.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    conf = df.sparkSession.conf
    if not 0 < int(conf.get(SETTING)) <= HANDED_OVER:
        conf.set(SETTING, HANDED_OVER)
    _ship(df.sparkSession.sparkContext.applicationId)
    return df.mapInArrow(tidy, schema)


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` (``doc_id`` if none are named) and ``text``, a null text as an empty one."""
    return docs.select(*(columns or ("doc_id",)), F.coalesce("text", F.lit("")).alias("text"))


def small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ROWS, and of TEXT_BYTES where no single text is longer."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy() if "text" in batch.schema.names else np.zeros(batch.num_rows)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            n = int(np.searchsorted(ends[at : at + ROWS], done + TEXT_BYTES, "right"))
            yield batch.slice(at, max(1, n))
            at += max(1, n)


def per_batch(
    df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str | StructType
) -> DataFrame:
    """``work`` turns each batch into columns by name; ``schema`` types them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(parsed)
        for batch in small(batches):
            columns = work(batch)
            yield pa.RecordBatch.from_arrays(
                [as_array(columns[f.name], f.type) for f in types], schema=types
            )

    parsed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return in_arrow(df, run, parsed)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)
