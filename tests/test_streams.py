"""Streams over several files give the batch result."""

from datetime import datetime

import pytest

from vacantis.operators import progress, upsert
from vacantis.session import fresh_folder
from vacantis.sources import bindings as b
from vacantis.sources import store, tables
from vacantis.streaming import ingest
from pyspark.sql import functions as F


def stamp():
    return F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))


def landed(spark, df, parts, by):
    path = fresh_folder(spark, "landed")
    df.repartitionByRange(parts, by).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def incoming(spark, sf_dir):
    return b.incoming(spark, sf_dir)


def test_ingest_stream_equals_merge_in_order(spark, sf_dir, incoming):
    jobs = b.jobs(spark, sf_dir)
    root, state = fresh_folder(spark, "store"), fresh_folder(spark, "state")
    tables.write_snapshot(jobs, root)
    # urls do not cross files, so one merge of everything is the expected result
    stream = landed(spark, incoming, 3, "url")
    version = ingest.ingest_stream(stream, root, state, stamp())
    assert version == 3
    want = upsert.upsert_fill_missing(jobs, upsert.dedup_batch(upsert.has_title_and_url(incoming)), stamp()).drop("change")
    got = tables.read_snapshot(spark, root)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # nothing new: the store stays at its version
    assert ingest.ingest_stream(stream, root, state, stamp()) == 3
    # a new checkpoint goes on from the latest version and loses nothing
    late = incoming.limit(3).withColumn("url", F.concat(F.lit("new-"), F.monotonically_increasing_id()))
    late = late.withColumn("title", F.lit("t")).withColumn("source", F.when(F.col("url") != "new-0", "s"))
    assert ingest.ingest_stream(landed(spark, late, 1, "url"), root, fresh_folder(spark, "state"), stamp(), skip_existing=True) == 4
    assert tables.read_snapshot(spark, root).count() == want.count() + 2
    assert store.committed(spark, root, state, 2) and not store.committed(spark, root, state, 3)


def test_stream_dedup_across_batches(spark, incoming):
    stream = ingest.stream_dedup_by_url(landed(spark, incoming, 3, "pos"))
    out = fresh_folder(spark, "out")
    stream.select("url").writeStream.format("parquet").option(
        "checkpointLocation", fresh_folder(spark, "state")
    ).trigger(availableNow=True).start(out).awaitTermination()
    got = [r["url"] for r in spark.read.schema("url string").parquet(out).collect()]
    want = {r["url"] for r in upsert.has_title_and_url(incoming).select("url").distinct().collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_stream_progress_equals_batch(spark, sf_dir):
    events = b.progress(spark, sf_dir)
    out = fresh_folder(spark, "progress")
    ingest.stream_progress(landed(spark, events, 3, "event_id"), out, fresh_folder(spark, "state"))
    got, want = ingest.read_progress(spark, out), progress.ingest_progress(events)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_task_totals_follow_from_source_states(spark, sf_dir):
    events = b.progress(spark, sf_dir)
    tasks = progress.ingest_progress(events).select("task_id", "processed_jobs", "total_jobs", "saved_jobs")
    sums = progress.source_progress(events).groupBy("task_id").agg(
        *[F.sum(c).alias(c) for c in ("processed_jobs", "total_jobs", "saved_jobs")]
    )
    assert tasks.exceptAll(sums).isEmpty()


def test_observed_counters(spark, sf_dir, incoming):
    merged = upsert.upsert_fill_missing(
        b.jobs(spark, sf_dir), upsert.dedup_batch(upsert.has_title_and_url(incoming)), stamp()
    )
    watched, seen = ingest.observed_ingest(merged)
    watched.write.format("noop").mode("overwrite").save()
    want = upsert.upsert_counts(merged).first()
    assert seen.get["saved"] == want["saved"] and seen.get["inserted"] == want["inserted"]


def test_declared_sources_without_events_are_queued(spark):
    event = "task_id long, source string, ts timestamp, event_id long, status string, processed_jobs int, total_jobs int, saved_jobs int, message string"
    stamp_of = __import__("datetime").datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, "a", stamp_of, 1, "completed", 3, 3, 2, "m")], event)
    declared = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "task_id long, source string")
    got = {r.task_id: (r.status, r.total_sources, r.completed_sources, r.progress_pct) for r in progress.ingest_progress(events, declared).collect()}
    assert got == {1: ("running", 2, 1, 100.0), 2: ("queued", 1, 0, 0.0)}


def test_task_status_shows_every_source(spark):
    event = "task_id long, source string, ts timestamp_ntz, event_id long, status string, processed_jobs int, total_jobs int, saved_jobs int, message string"
    at = lambda day: datetime(2024, 1, day)
    events = spark.createDataFrame([
        (1, "b", at(1), 1, "running", 1, 4, 1, "m1"), (1, "a", at(2), 2, "running", 0, 0, 0, None),
        (1, "b", at(3), 3, "running", 3, 4, 2, "m3"), (1, "a", at(3), 4, "error", 0, 0, 0, "broken"),
    ], event)
    declared = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "task_id long, source string")
    status = progress.task_status(events, declared)
    assert status.columns == progress.STATUS
    one, two = status.orderBy("task_id").collect()
    assert (one.status, one.message, one.queued_sources) == ("running", "Procesando fuente: a", ["a", "b", "c"])
    assert (one.current_source, one.started_at, one.updated_at, one.progress_pct) == ("b", at(1), at(3), 75.0)
    assert {k: tuple(v) for k, v in one.sources.items()} == {
        "a": ("error", 0, 0, 0, 100.0, "broken"), "b": ("running", 3, 4, 2, 75.0, "m3"), "c": ("queued", 0, 0, 0, 0.0, "Pendiente"),
    }
    assert (two.status, two.message, two.started_at, two.updated_at) == ("queued", "Scraping encolado", None, None)
    assert tuple(two.sources["a"]) == ("queued", 0, 0, 0, 0.0, "Pendiente")
    assert status.where("task_id = 1").select("processed_jobs").first() == progress.ingest_progress(events, declared).where("task_id = 1").select("processed_jobs").first()
    assert progress.task_status(events.limit(0)).isEmpty()
