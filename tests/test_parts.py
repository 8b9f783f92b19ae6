"""Merges whose sides meet bucket by bucket, batches in buckets, and shuffle files that go."""

import os
import time

import pytest
from plans import below, plan_of
from pyspark.sql import functions as F
from test_bucketed import now, without_broadcast
from test_late_texts import rows_of, tables as small

from vacantis import session
from vacantis.operators import upsert
from vacantis.session import fresh_folder, stored, stored_by, writing
from vacantis.sources import store, tables


@pytest.mark.parametrize("hashed", [2_000_000, 0])
def test_a_large_batch_moves_no_stored_row(spark, monkeypatch, hashed):
    monkeypatch.setattr(upsert, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(upsert, "HASHED_ROWS", hashed)
    jobs, batch = small(spark)
    root = fresh_folder(spark, "parts")
    tables.write_snapshot(tables.dealt(jobs, 4).drop("bucket"), root, 4, is_dealt=True)
    got = tables.merged_snapshot(spark, root, batch, now())
    plan = plan_of(got)
    assert "Exchange" not in plan and "Broadcast" not in plan
    assert ("ShuffledHashJoin" if hashed else "SortMergeJoin") in plan
    assert rows_of(got) == rows_of(upsert.upsert_fill_missing(jobs, batch, now()))
    version = tables.write_snapshot(got.drop("change"), root, 4, is_dealt=True)
    assert tables.read_snapshot(spark, root, version).count() == got.count()
    listed = [r.bucket for r in store.manifest(spark, root, version).where("file is not null").collect()]
    assert max(listed.count(x) for x in listed) <= 2


def test_untouched_buckets_and_empty_batches(spark, monkeypatch):
    monkeypatch.setattr(upsert, "BROADCAST_ROWS", -1)
    jobs, batch = small(spark)
    root = fresh_folder(spark, "parts")
    tables.write_snapshot(tables.dealt(jobs, 16).drop("bucket"), root, 16, is_dealt=True)
    for some in (batch.where("url = 'u1'"), batch.limit(0)):
        got = tables.merged_snapshot(spark, root, some, now())
        assert rows_of(got) == rows_of(upsert.upsert_fill_missing(jobs, some, now()))


def test_a_batch_in_buckets_is_not_shuffled_again(spark):
    jobs, batch = small(spark)
    with without_broadcast(spark):
        kept = stored_by(upsert.dedup_batch(batch.withColumns({c: F.lit(1) for c in upsert.RUN_ORDER})), "url", 8, "batch")
        plan = plan_of(upsert.new_only(kept, jobs))
    assert "Bucketed: true" in plan and not [x for x in below(plan, "Exchange") if "Bucketed" in x]
    assert sorted(r.url for r in upsert.new_only(kept, jobs).collect()) == ["u3", "u4"]


def test_shuffle_files_go_with_their_job(spark, tmp_path, monkeypatch):
    def files():
        conf = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in conf for _, _, names in os.walk(d.toString()) for f in names if f.startswith("shuffle_")}

    before = files()
    df = stored(spark.range(1000).repartition(7, "id"), "tidy")
    with writing(spark, 4):
        df.repartition(5, "id").write.parquet(str(tmp_path / "out"))
    for _ in range(100):  # they go in the background
        left = [f for f in files() - before if f.endswith(".data")]
        if not left:
            break
        time.sleep(0.2)
    assert df.count() == 1000 and not left
    assert all(spark.conf.get(name) == "false" for name in session.TIDY)


def test_rows_dealt_out_by_files_need_no_shuffle(spark):
    jobs, _ = small(spark)
    got = store.dealt_by_files(jobs, ["url", "id"], 4)
    assert "Exchange" not in plan_of(got) and got.exceptAll(jobs).isEmpty() and got.count() == jobs.count()
    tasks = got.select(store.bucket_of(["url", "id"], 4).alias("b"), F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == len({r.b for r in tasks}) == len({r.task for r in tasks}) > 1
    assert store.dealt_by_files(jobs.limit(0), ["url", "id"], 4).count() == 0
