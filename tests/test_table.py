"""Search, paging, constraints, merge and their plans."""

import pytest
from pyspark.sql import functions as F

from plans import plan_of
from vacantis import schema
from vacantis.operators import counts, derive, extract, search, upsert
from vacantis.plans import forecast, overview
from vacantis.session import fresh_folder
from vacantis.sources import bindings as b
from vacantis.sources import tables


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    path = fresh_folder(spark, "stored")
    tables.append_jobs(b.jobs(spark, sf_dir), path)
    return tables.scan_jobs(spark, path)


@pytest.fixture(scope="module")
def arrived(spark, sf_dir):
    return upsert.dedup_batch(upsert.has_title_and_url(b.incoming(spark, sf_dir))).cache()


def rows(df):
    return sorted(map(str, df.collect()))


def test_bounds(stored):
    for call in (
        lambda: search.search_jobs(stored, limit=201), lambda: search.search_jobs(stored, offset=-1),
        lambda: overview.overview(stored, top_n=51), lambda: forecast.demand_forecast(stored, months_ahead=13),
        lambda: forecast.forecast_confidence(stored, test_months=7),
    ):
        with pytest.raises(ValueError):
            call()


def test_top_n_has_a_floor(stored):
    few = overview.overview(stored, top_n=1).where("metric = 'top_cities'").count()
    assert few == 10


def test_filters_reach_the_scan(stored):
    plan = plan_of(search.filter_jobs(stored, source="2-HIGH", work_mode="remote").select("id"))
    assert "EqualTo(source,2-HIGH)" in plan and "EqualTo(work_mode,remote)" in plan
    assert "description" not in plan.split("ReadSchema:")[1].splitlines()[0]


def test_backslash_in_search(stored):
    assert search.text_search(stored, r"b\ackend").count() == search.text_search(stored, "backend").count() > 0
    assert search.text_search(stored, r"100\%").count() > 0
    assert search.text_search(stored, r"1\%0").count() == 0


def test_empty_parameters_set_no_test(stored):
    assert search.matching(stored, search="", source="", city=None).count() == stored.count()


@pytest.mark.parametrize("offset", [0, 777, 1470, 1490, 5000])
def test_page_of_all_rows_in_order(stored, offset):
    rows = sorted(stored.select("id", "scraped_at").collect(), key=lambda r: (r.scraped_at is not None, r.scraped_at or 0, r.id), reverse=True)
    assert search.newest_first(stored, 20, offset).select("id", "scraped_at").collect() == rows[offset : offset + 20]


def test_get_by_url_null(spark):
    df = spark.createDataFrame([(1, None), (2, "u")], "id long, url string")
    assert [r["id"] for r in search.get_by_url(df, None).collect()] == [1]


def test_constraints(spark):
    data = [(1, "s", "t", "u"), (2, "s", "t", "u"), (3, None, "t", "v"), (4, "s", None, "w"), (5, "s", "t", None), (6, "s", "t", None)]
    df = spark.createDataFrame(data, "id long, source string, title string, url string")
    valid, bad = schema.split_invalid(df)
    assert sorted(r["id"] for r in valid.collect()) == [1, 5, 6]
    assert {r["id"]: r["violation"] for r in bad.collect()} == {2: "duplicate_url", 3: "missing_source", 4: "missing_title"}


def test_equal_rows_take_a_url_once(spark):
    data = [(None, "s", "t", "u")] * 2 + [(None, "s", "t", "v")] * 3 + [(None, None, "t", "w")] * 2 + [(None, "s", "t", None)] * 2
    valid, bad = schema.split_invalid(spark.createDataFrame(data, "id long, source string, title string, url string"))
    assert sorted(str(r["url"]) for r in valid.collect()) == ["None", "None", "u", "v"]
    assert sorted((r["url"], r["violation"]) for r in bad.collect()) == [
        ("u", "duplicate_url"), ("v", "duplicate_url"), ("v", "duplicate_url"), ("w", "missing_source"), ("w", "missing_source"),
    ]


def test_a_search_runs_once_for_total_and_page(stored):
    total, page = search.search_jobs(stored, search="dev", limit=7, offset=40)
    want = search.matching(stored, "dev").select("id", "scraped_at").collect()
    want.sort(key=lambda r: (r.scraped_at is not None, r.scraped_at or 0, r.id), reverse=True)
    assert total.first()["total"] == len(want) and [r.id for r in page.collect()] == [r.id for r in want[40:47]]
    plan = plan_of(page)
    assert "ilike" not in plan.lower() and "offset=" not in plan.lower()


def test_conform_schema_keeps_current_columns(stored):
    assert schema.conform_schema(stored).columns == stored.columns


def test_merge_twice_changes_nothing(spark, stored, arrived):
    root = fresh_folder(spark, "merge")
    tables.write_snapshot(upsert.upsert_fill_missing(stored, arrived).drop("change"), root)
    once = tables.read_snapshot(spark, root)
    again = upsert.upsert_fill_missing(once, arrived)
    assert upsert.upsert_counts(again).first()["inserted"] == 0
    left, right = once.drop("scraped_at"), again.drop("change", "scraped_at")
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_merge_counts_add_up(stored, arrived):
    got = upsert.upsert_counts(upsert.upsert_fill_missing(stored, arrived)).first()
    assert got["inserted"] + got["enriched"] + got["unchanged"] == arrived.count()
    assert got["saved"] == got["inserted"] + got["enriched"]
    assert upsert.new_only(arrived, stored).count() == got["inserted"]


def test_fill_missing_keeps_blank_and_counts_empty_list(spark):
    base = {f.name: None for f in schema.JOBS_SCHEMA}
    old = [base | dict(id=1, title="t", url="u", company="", city="X"), base | dict(id=2, title="t", url=None)]
    new = base | dict(title="t", url="u", company="", city="Y", skills=["  "])
    existing = spark.createDataFrame([tuple(r.values()) for r in old], schema.JOBS_SCHEMA)
    incoming = spark.createDataFrame([tuple(new.values())], schema.JOBS_SCHEMA)
    got = {r["id"]: r for r in upsert.upsert_fill_missing(existing, incoming).collect()}
    assert (got[1]["company"], got[1]["city"], got[1]["skills"], got[1]["change"]) == ("", "X", None, "enriched")
    assert got[2]["change"] is None


def test_hot_url_is_cut_before_the_shuffle(spark):
    rows_ = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("url"),
        F.col("id").alias("term_seq"), F.lit(0).alias("page_seq"), F.lit(0).alias("pos"),
    )
    deduped = upsert.dedup_batch(rows_)
    plan = plan_of(deduped)
    assert plan.index("WindowGroupLimit", plan.index("Exchange")) > 0
    assert deduped.count() == 20001 and deduped.where("url = 'hot'").first()["term_seq"] == 0


def test_top_k_is_cut_before_the_shuffle(stored):
    plan = plan_of(counts.top_k(counts.ingest_stats(stored), 10, "jobs", "value", per="metric"))
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("report", [overview.overview, forecast.demand_forecast, forecast.forecast_confidence])
def test_reports_read_the_table_once(stored, report):
    plan = plan_of(report(stored))
    wide = [line for line in plan.splitlines() if "FileScan" in line and "skills" in line]
    assert len(wide) == 1
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert bad not in plan


def test_small_batch_does_not_shuffle_the_table(stored, arrived):
    batch = arrived.sparkSession.createDataFrame(arrived.limit(5).collect(), arrived.schema)
    merged = upsert.upsert_fill_missing(stored, batch)
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan


def test_row_order_does_not_matter(stored):
    mixed = stored.orderBy(F.xxhash64("id")).repartition(5)
    for report in (overview.overview, forecast.demand_forecast, forecast.forecast_confidence):
        assert rows(report(stored)) == rows(report(mixed))


def test_counts_and_blanks_add_up(stored):
    for column in ("source", "city", "contract_type", "seniority"):
        counted = counts.value_counts(stored, column).agg(F.sum("jobs")).first()[0]
        blank = stored.where(F.col(column).isNull() | (F.col(column) == "")).count()
        assert counted + blank == stored.count()


def test_changed_rows_match_backfill(stored):
    after = derive.backfill_derived(stored)
    assert derive.changed_rows(stored).count() == after.exceptAll(stored).count()


def test_empty_selection_reports_zero(stored):
    got = {(r["metric"], r["key"]): r["value"] for r in overview.overview(stored, source="nowhere").collect()}
    assert got == {
        ("total_jobs", ""): 0.0, ("salary", "avg_salary_min"): None, ("salary", "avg_salary_max"): None,
        ("salary", "with_salary_min_count"): 0.0, ("salary", "with_salary_max_count"): 0.0,
    }


def test_a_refused_row_takes_no_url(spark):
    rows = [(1, "s", None, "u"), (2, "s", "t", "u"), (3, "s", "t", "u"), (4, None, "t", "v"), (5, "s", "t", "v"), (6, "s", "t", None), (7, "s", "t", None)]
    valid, refused = schema.split_invalid(spark.createDataFrame(rows, "id long, source string, title string, url string"))
    assert sorted(r.id for r in valid.collect()) == [2, 5, 6, 7]
    assert {r.id: r.violation for r in refused.collect()} == {1: "missing_title", 3: "duplicate_url", 4: "missing_source"}


def test_page_fetched_twice_gives_one_posting(spark, sf_dir):
    stamp = F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))
    listing, details, micro = (f(spark, sf_dir) for f in (b.listing_pages, b.detail_pages, b.microdata_pages))
    listing, details, micro = listing.limit(3), details.limit(40), micro.limit(20)
    again = lambda df: df.union(df.withColumn("page_id", F.col("page_id") + 1_000_000))
    once = extract.build_raw_postings(listing, details, micro, stamp)
    twice = extract.build_raw_postings(listing, again(details), again(micro), stamp)
    urls = [r.url for r in twice.select("url").collect()]
    assert len(urls) == len(set(urls)) and set(urls) == {r.url for r in once.select("url").collect()}
    # a first fetch without title does not hide the second
    blank = micro.withColumn("html", F.regexp_replace("html", "(?s)<h1.*?</h1>", "")).union(micro.withColumn("page_id", F.col("page_id") + 1_000_000))
    found = {r.url for r in extract.build_raw_postings(listing, details, blank, stamp).select("url").collect()}
    assert found == set(urls)


def test_merge_dedups_the_batch_once(stored, arrived):
    assert "Window" not in plan_of(upsert.upsert_fill_missing(stored, arrived))
