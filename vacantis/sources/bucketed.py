"""Postings in Spark's own hash buckets of their url, so that a merge reads them without a shuffle.

    path/by_url_<n>/       postings with a url: n buckets, each in files of its own
    path/without_url/      the others; no batch can mention them, and in a bucket they would be one hot key

Spark knows from the table's declaration that equal urls share a bucket. A batch is stored in as many buckets of its url, by the
shuffle of its dedup; where it is too large to broadcast each task joins a bucket of both as they lie on disk. What a
merge returns is dealt out likewise, so it is written to the next table without a shuffle either: a bucket
then holds a file of known postings and one of new ones, until ``write_bucketed`` lays the table out anew.

A table is written once, to a path of its own. Its declaration lives in the session's catalog only; files need none
to be read. An empty table has no rows and merges like any other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantis.operators import upsert
from vacantis.schema import JOBS_SCHEMA
from vacantis.session import TIDY, in_order, settings, stored, stored_by, writing

BUCKETS = 32


def _keyed(path: str, buckets: int) -> str:
    return f"{path.rstrip('/')}/by_url_{buckets}"


def _loose(path: str) -> str:
    return f"{path.rstrip('/')}/without_url"


def _save(keyed: DataFrame, loose: DataFrame, path: str, buckets: int) -> None:
    """Bucket files are written through a table; it is dropped at once, its files stay."""
    spark, name = keyed.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    with writing(spark, buckets):
        keyed.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "url").option("path", _keyed(path, buckets)).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    with settings(spark, TIDY):
        loose.write.option("compression", "zstd").parquet(_loose(path))


def write_bucketed(
    df: DataFrame, path: str, buckets: int = BUCKETS, late: Callable[[DataFrame], DataFrame] | None = None, order: Sequence[str] = ()
) -> None:
    """Lay a whole table out by url: one shuffle, one file per bucket.

    ``late`` adds the columns that rows come without after the shuffle, to rows in ``order`` in each task: texts are
    not shuffled then, and equal ones lie side by side.
    """

    def whole(rows: DataFrame) -> DataFrame:
        if order:
            rows = in_order(rows, *order)
        return (rows if late is None else late(rows)).select(*JOBS_SCHEMA.names)

    keyed = df.where(F.col("url").isNotNull()).repartition(buckets, "url")
    _save(whole(keyed), whole(df.where(F.col("url").isNull())), path, buckets)


def scan_keyed(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The postings with a url, declared as bucketed by it."""
    place = _keyed(path, buckets)
    name = f"bucketed_{hashlib.sha256(place.encode()).hexdigest()[:32]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in JOBS_SCHEMA)
    location = place.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (url) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return spark.table(name)


def scan_loose(spark: SparkSession, path: str) -> DataFrame:
    """The postings without a url."""
    return spark.read.schema(JOBS_SCHEMA).parquet(_loose(path))


def scan_bucketed(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """All postings of a table."""
    return scan_keyed(spark, path, buckets).unionByName(scan_loose(spark, path))


def merged_keyed(
    spark: SparkSession, path: str, incoming: DataFrame, ingest_ts: Column | None = None, buckets: int = BUCKETS, is_stored: bool = False
) -> DataFrame:
    """``upsert.upsert_fill_missing`` of a batch into the postings with a url, with its ``change`` column."""
    incoming = incoming if is_stored else stored(incoming, "batch")
    return upsert.upsert_fill_missing(scan_keyed(spark, path, buckets), incoming, ingest_ts, is_stored=True, has_urls=True, buckets=buckets)


def merge_bucketed(
    spark: SparkSession, path: str, incoming: DataFrame, target: str, ingest_ts: Column | None = None, buckets: int = BUCKETS
) -> None:
    """Merge a batch (one row per url) into the table at ``path``; the result is a table of its own at ``target``."""
    merged = merged_keyed(spark, path, stored_by(incoming, "url", buckets, "batch"), ingest_ts, buckets, is_stored=True)
    _save(merged.drop("change"), scan_loose(spark, path), target, buckets)
