"""Session helpers: a local session for tests and bench, and the shared work folder."""

from __future__ import annotations

import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, name: str = "vacantis") -> SparkSession:
    """Local session for tests and bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else one below the warehouse.

    Beyond a local session a warehouse on the driver's own disk is refused: executors would not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    local = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    if local and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder; removed when the session's JVM ends."""
    parent = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{parent}/data"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, label)
    with settings(df.sparkSession, TIDY):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """``stored`` in Spark's own buckets of ``key``: joins and groups by it read the rows without a shuffle.

    A shuffle by ``key`` that ``df`` ends with, such as that of a dedup, deals the rows out to the buckets on its way.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    with writing(spark, buckets), settings(spark, {"spark.sql.shuffle.partitions": str(buckets)}):
        df.write.format("parquet").bucketBy(buckets, key).option("path", fresh_folder(spark, label)).saveAsTable(name)
    return spark.table(name)


def in_one_task(df: DataFrame) -> DataFrame:
    """All rows in one task, also below a join: two such sides meet without a shuffle. A filter as in ``in_order`` keeps joins above it."""
    return df.coalesce(1).where(F.monotonically_increasing_id() >= 0)


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in order within each partition, also below a join that streams them.

    The optimizer drops a sort below a join; it keeps one below a filter that is not deterministic. All rows pass it.
    """
    return df.sortWithinPartitions(*columns).where(F.monotonically_increasing_id() >= 0)


# Shuffle files go when the job that wrote them has ended, and not only when the driver collects its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def writing(spark: SparkSession, buckets: int) -> Iterator[None]:
    """Settings for writes into buckets that leave rows in the order they come in, and no shuffle files behind.

    A task keeps a file open for each bucket instead of sorting whole rows by it, and two sides that are dealt out by
    bucket are joined on (bucket, url) as they lie.
    """
    wanted = {
        "spark.sql.maxConcurrentOutputFileWriters": str(buckets),
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    with settings(spark, wanted | TIDY):
        yield
