"""Postings bucketed by url: merges that leave the stored side where it is."""

from contextlib import contextmanager

import pytest
from plans import below, plan_of
from pyspark.sql import functions as F

from vacantis import schema
from vacantis.operators import upsert
from vacantis.session import fresh_folder
from vacantis.sources import bindings as b
from vacantis.sources import bucketed


def now():
    return F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))



@contextmanager
def without_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrived(spark, sf_dir):
    return upsert.dedup_batch(upsert.has_title_and_url(b.incoming(spark, sf_dir)))


def same(one, other):
    columns = schema.JOBS_SCHEMA.names
    one, other = one.select(columns), other.select(columns)
    assert one.count() == other.count()
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


@pytest.fixture(scope="module")
def jobs_path(spark, sf_dir):
    path = fresh_folder(spark, "bucketed")
    bucketed.write_bucketed(b.jobs(spark, sf_dir), path, 8)
    return path


def test_a_large_batch_does_not_shuffle_the_stored_side(spark, sf_dir, jobs_path):
    with without_broadcast(spark):
        plan = plan_of(bucketed.merged_keyed(spark, jobs_path, arrived(spark, sf_dir), now(), 8))
        plain = plan_of(upsert.upsert_fill_missing(b.jobs(spark, sf_dir), arrived(spark, sf_dir), now()))
    assert plan.count("Bucketed: true") == 2  # rows to fill, and known urls
    shuffled = [x for x in below(plan, "Exchange") if "FileScan" in x]
    assert shuffled and not [x for x in shuffled if "Bucketed: true" in x]
    assert [x for x in below(plain, "Exchange") if "orders" in x and "FileScan" in x]


@pytest.mark.parametrize("large", [False, True])
def test_merge_equals_the_plain_one(spark, sf_dir, jobs_path, large):
    jobs, batch, target = b.jobs(spark, sf_dir), arrived(spark, sf_dir), fresh_folder(spark, "merged")
    same(bucketed.scan_bucketed(spark, jobs_path, 8), jobs)
    if large:
        with without_broadcast(spark):
            bucketed.merge_bucketed(spark, jobs_path, batch, target, now(), 8)
    else:
        bucketed.merge_bucketed(spark, jobs_path, batch, target, now(), 8)
    same(bucketed.scan_bucketed(spark, target, 8), upsert.upsert_fill_missing(jobs, batch, now()))
    # the result is bucketed again: a second merge finds every url, and shuffles no stored row either
    with without_broadcast(spark):
        again = bucketed.merged_keyed(spark, target, batch, now(), 8)
        assert not [x for x in below(plan_of(again), "Exchange") if "Bucketed: true" in x]
        assert upsert.upsert_counts(again).first()["inserted"] == 0


def test_a_merge_that_lays_out_its_result_writes_without_a_shuffle_of_stored_rows(spark, sf_dir, jobs_path):
    with without_broadcast(spark):
        target = fresh_folder(spark, "merged")
        bucketed.merge_bucketed(spark, jobs_path, arrived(spark, sf_dir), target, now(), 8)
    files = [f.rsplit("_", 1)[1] for f in spark.read.parquet(f"{target}/by_url_8").inputFiles()]
    # at most one file of known and one of new postings in a bucket
    assert max(files.count(x) for x in files) <= 2 and len(set(files)) <= 8


def test_rows_without_url_empty_tables_and_odd_names(spark):
    rows = [(i, "a", "t", u) for i, u in enumerate(["u1", "u2", None, None, "", "u'3"])]
    given = spark.createDataFrame(rows, "id long, source string, title string, url string")
    none = spark.createDataFrame([], schema.JOBS_SCHEMA)
    jobs = none.unionByName(given, allowMissingColumns=True).withColumn("more", F.lit(1))
    arriving = spark.createDataFrame(
        [("u1", "a", "t", "c"), ("u9", "a", "t", "c")], "url string, source string, title string, company string"
    )
    batch = none.drop("id").unionByName(arriving, allowMissingColumns=True)
    for table in (jobs, jobs.limit(0)):
        path, target = (fresh_folder(spark, "it's") for _ in range(2))
        bucketed.write_bucketed(table, path, 4)
        bucketed.merge_bucketed(spark, path, batch, target, now(), 4)
        same(bucketed.scan_bucketed(spark, target, 4), upsert.upsert_fill_missing(table, batch, now()))
    target = fresh_folder(spark, "none")
    bucketed.merge_bucketed(spark, path, batch.limit(0), target, now(), 4)  # nothing into an empty table
    assert bucketed.scan_bucketed(spark, target, 4).count() == 0
