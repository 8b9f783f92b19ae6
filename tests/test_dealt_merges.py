"""Merges into stores whose rows stay in their buckets, unsorted."""

from plans import plan_of
from test_bucketed import now, without_broadcast
from test_late_texts import rows_of, tables as small

import __spark_entry__ as entry
from vacantis import schema
from vacantis.operators import upsert
from vacantis.session import fresh_folder, writing
from vacantis.sources import bindings as b
from vacantis.sources import bucketed, store, tables


def test_a_large_batch_is_met_by_hash_in_each_bucket(spark, monkeypatch):
    monkeypatch.setattr(upsert, "BROADCAST_ROWS", 0)
    jobs, batch = small(spark)
    root = fresh_folder(spark, "dealt")
    tables.write_snapshot(tables.dealt(jobs, 4).drop("bucket"), root, 4, is_dealt=True)
    want = rows_of(upsert.upsert_fill_missing(jobs, batch, now()))
    with without_broadcast(spark), writing(spark, 4):
        deal, buckets = store.dealer(spark, root)
        got = upsert.upsert_fill_missing(tables.read_snapshot(spark, root), batch, now(), dealt=deal, buckets=buckets)
        plan = plan_of(got)
        assert "ShuffledHashJoin" in plan and rows_of(got) == want
        joined = plan[plan.index("ShuffledHashJoin"):].split("Union")[0]
        assert "hashpartitioning(bucket" in joined and "hashpartitioning(_key" not in joined
        version = tables.write_snapshot(got.drop("change"), root, 4, is_dealt=True)
    assert tables.read_snapshot(spark, root, version).count() == len(want)
    listed = [r.bucket for r in store.manifest(spark, root, version).where("file is not null").collect()]
    assert max(listed.count(x) for x in listed) <= 2


def test_first_versions_get_their_texts_after_the_shuffle(spark, sf_dir):
    with without_broadcast(spark):
        plan = plan_of(b.with_texts(spark, sf_dir)(entry._laid(b.slim_jobs(spark, sf_dir))))
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert "doc_slot" in joins[0] and "Exchange" in plan


def test_a_bucketed_table_gets_its_texts_after_the_shuffle(spark):
    jobs, _ = small(spark)
    texts = jobs.select("id", "description")
    path = fresh_folder(spark, "late")
    bucketed.write_bucketed(jobs.drop("description"), path, 4, late=lambda df: df.join(texts, "id", "left"), order=["id"])
    got = bucketed.scan_bucketed(spark, path, 4).select(schema.JOB_COLUMNS)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, jobs.collect()))
