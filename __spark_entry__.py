"""

Every query binds the given tables to the posting schema (vacantis.sources.bindings) and
runs one operator over the whole of them. Nested results are shown as JSON text.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oracles.sql import ORACLES
from vacantis import fixed_values as fixed
from vacantis import schema
from vacantis.functions import pages, parsing, skills, text
from vacantis.operators import counts, derive, extract, progress, search, series, upsert
from vacantis.plans import forecast, overview
from vacantis.session import fresh_folder, in_order
from vacantis.sources import bindings as b
from vacantis.sources import bucketed, store, tables
from vacantis.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
C = F.col


def _installed(module: str) -> bool:
    try:
        return importlib.util.find_spec(module) is not None
    except ModuleNotFoundError:
        return False


# The training-data operators are an optional subpackage; only its absence is passed over.
llm = importlib.import_module("vacantis.llm.queries") if _installed("vacantis.llm.queries") else None


def _ingest_ts() -> Column:
    return F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))


def _json(df: DataFrame, *columns: str) -> DataFrame:
    """Nested columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def _jobs(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: fn(b.jobs(spark, d))


def _texts(column: str, **rules: Callable[[Column], Column]) -> Query:
    return lambda spark, d: b.field_texts(spark, d).select(
        "id", column, *[rule(C(column)).alias(name) for name, rule in rules.items()]
    )


def _arrived(spark: SparkSession, d: str) -> DataFrame:
    return upsert.dedup_batch(upsert.has_title_and_url(b.incoming(spark, d)))


def _merged(spark: SparkSession, d: str, laid: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    return upsert.upsert_fill_missing(
        b.slim_jobs(spark, d), _arrived(spark, d), _ingest_ts(), late=b.with_texts(spark, d), laid=laid
    )


def _merged_blankness(spark: SparkSession, d: str) -> DataFrame:
    """``_merged`` with texts and skills cut to what its changes depend on."""
    arrived = upsert.dedup_batch(upsert.has_title_and_url(upsert.only_blankness(b.incoming(spark, d))))
    return upsert.upsert_fill_missing(
        upsert.only_blankness(b.slim_jobs(spark, d)), arrived, _ingest_ts(), late=b.with_texts(spark, d, letters=1)
    )


def _shown(df: DataFrame) -> DataFrame:
    """A merged table without surrogate ids."""
    return _json(df.drop("id"), "skills")


def _laid(slim: DataFrame) -> DataFrame:
    """Rows without texts dealt out to a store's buckets, those of one document side by side."""
    return in_order(tables.dealt(slim), "doc_slot")


def _laid_by_files(slim: DataFrame) -> DataFrame:
    """``_laid`` without a shuffle: those of the merge end before."""
    return in_order(store.dealt_by_files(slim, ["url", "id"]), "doc_slot")


def _store_jobs(spark: SparkSession, d: str, root: str) -> None:
    """The first version of a store."""
    jobs = b.with_texts(spark, d)(_laid(b.slim_jobs(spark, d)))
    tables.write_snapshot(jobs.select(*schema.JOB_COLUMNS), root, is_dealt=True)


def _months(spark: SparkSession, d: str) -> DataFrame:
    return counts.skill_month_counts(b.jobs(spark, d))


def _raw_postings(spark: SparkSession, d: str) -> DataFrame:
    return extract.build_raw_postings(
        b.listing_pages(spark, d), b.slim_detail_pages(spark, d), b.slim_microdata_pages(spark, d), _ingest_ts(),
        b.with_detail_html(spark, d), b.with_microdata_html(spark, d),
    )


def _task_progress(spark: SparkSession, d: str) -> DataFrame:
    states = progress.latest_states(b.progress(spark, d))
    return progress.task_progress_of(progress.with_declared(states, b.declared_of(states)))


def _task_status(spark: SparkSession, d: str) -> DataFrame:
    states = progress.states_with_position(b.progress(spark, d))
    status = progress.task_status_of(progress.with_declared(states, b.declared_of(states)))
    return _json(status, "queued_sources", "sources")


# --- sources and sinks -------------------------------------------------------

def s3_declared_schema(spark: SparkSession, d: str) -> DataFrame:
    shaped = schema.project_read_shape(b.jobs(spark, d))
    filled = shaped.select(*[F.count(c).alias(c) for c in schema.JOB_COLUMNS])
    return filled.unpivot([], schema.JOB_COLUMNS, "column", "filled")


def s4_conform_schema(spark: SparkSession, d: str) -> DataFrame:
    old = b.jobs(spark, d).select("id", "title", C("contract_type").alias("remote_type"))
    return schema.conform_schema(old)


def s5_append_jobs(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_folder(spark, "append")
    arrived = upsert.stored_batch(_arrived(spark, d))
    new = upsert.new_only(arrived, b.slim_jobs(spark, d))
    tables.append_jobs(b.jobs_by_text(spark, d), path)
    tables.append_jobs(schema.project_read_shape(upsert.as_new(new, _ingest_ts())), path)
    return _shown(tables.scan_jobs(spark, path))


def s6_write_snapshot(spark: SparkSession, d: str) -> DataFrame:
    root = fresh_folder(spark, "snapshot")
    _store_jobs(spark, d, root)
    merged = tables.merged_snapshot(spark, root, _arrived(spark, d), _ingest_ts())
    version = tables.write_snapshot(merged.drop("change"), root, is_dealt=True)
    return _shown(tables.read_snapshot(spark, root, version))


def j2_merge_bucketed(spark: SparkSession, d: str) -> DataFrame:
    path, target = fresh_folder(spark, "bucketed"), fresh_folder(spark, "bucketed-merged")
    bucketed.write_bucketed(b.slim_jobs(spark, d), path, late=b.with_texts(spark, d), order=["doc_slot"])
    bucketed.merge_bucketed(spark, path, _arrived(spark, d), target, _ingest_ts())
    return _shown(bucketed.scan_bucketed(spark, target))


# --- streams -----------------------------------------------------------------

def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    table_schema = b.given(spark, d, name).schema
    return spark.readStream.schema(table_schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def t1_ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    root = fresh_folder(spark, "ingest")
    _store_jobs(spark, d, root)
    ingest.ingest_stream(
        b.incoming_of(_stream(spark, d, "lineitem")), root, fresh_folder(spark, "ingest-state"), _ingest_ts()
    )
    return _shown(tables.read_snapshot(spark, root))


def t2_stream_dedup_by_url(spark: SparkSession, d: str) -> DataFrame:
    out = fresh_folder(spark, "dedup")
    stream = ingest.stream_dedup_by_url(b.incoming_of(_stream(spark, d, "lineitem")))
    query = (
        stream.select("url").writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", fresh_folder(spark, "dedup-state"))
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema("url string").parquet(out)


def t3_stream_progress(spark: SparkSession, d: str) -> DataFrame:
    out = fresh_folder(spark, "progress")
    ingest.stream_progress(
        b.progress_of(_stream(spark, d, "events")), out, fresh_folder(spark, "progress-state"), b.declared_sources(spark, d)
    )
    return ingest.read_progress(spark, out)


def t4_ingest_metrics(spark: SparkSession, d: str) -> DataFrame:
    watched, seen = ingest.observed_ingest(_merged(spark, d, _laid_by_files))
    tables.write_snapshot(watched.drop("change"), fresh_folder(spark, "observed"), is_dealt=True)
    return spark.createDataFrame([seen.get], "processed long, saved long, inserted long")


def t4_stream_ingest_metrics(spark: SparkSession, d: str) -> DataFrame:
    root = fresh_folder(spark, "counted")
    _store_jobs(spark, d, root)
    ingest.ingest_stream(b.incoming_of(_stream(spark, d, "lineitem")), root, fresh_folder(spark, "counted-state"), _ingest_ts())
    totals = ingest.ingest_totals(spark, root)
    return spark.createDataFrame([tuple(totals[c] for c in ingest.COUNTERS)], "processed long, saved long, inserted long")


def queries() -> dict[str, Query]:
    """One entry per operator of the inventory."""
    q: dict[str, Query] = {}

    # scans, sources, sinks
    q["s1_scan_jobs"] = _jobs(lambda j: _json(j, "skills"))
    q["s2_scan_for_analytics"] = _jobs(
        lambda j: _json(tables.scan_for_analytics(j, "2-HIGH", "CUCUTA"), "skills")
    )
    q["s3_declared_schema"] = s3_declared_schema
    q["s4_conform_schema"] = s4_conform_schema
    q["s5_append_jobs"] = s5_append_jobs
    q["s6_write_snapshot"] = s6_write_snapshot
    q["s7_scan_pages"] = lambda spark, d: tables.scan_pages(spark, f"{d}/pages.parquet")

    # filters and lookups
    q["f1_filter_jobs"] = _jobs(
        lambda j: search.filter_jobs(j, "1-URGENT", "", "Full time", "remote").select("id", "source", "title")
    )
    q["f2_text_search"] = _jobs(lambda j: search.text_search(j, "DEV%er").select("id", "title", "company"))
    q["f3_get_by_id"] = _jobs(lambda j: _json(search.get_by_id(j, 123), "skills"))
    q["f4_get_by_url"] = _jobs(lambda j: _json(search.get_by_url(j, "https://jobs.example/321"), "skills"))
    q["f5_project_read_shape"] = _jobs(lambda j: _json(schema.project_read_shape(j), "skills"))
    q["f6_non_empty"] = _jobs(lambda j: search.with_value(j, "contract_type").select("id", "contract_type"))
    q["f7_split_invalid"] = lambda spark, d: schema.split_invalid(
        b.incoming(spark, d).withColumn("title", text.non_empty(C("title"))), list(upsert.RUN_ORDER)
    )[1].select(*upsert.RUN_ORDER, "url", "violation")
    q["f9_parameter_bounds"] = _jobs(
        lambda j: search.newest_first(j, search.bounded("limit", fixed.SEARCH_LIMIT[1], fixed.SEARCH_LIMIT), 3).select("id")
    )
    q["f8_has_title_and_url"] = lambda spark, d: upsert.has_title_and_url(b.incoming(spark, d)).select(
        *upsert.RUN_ORDER, "url", "title"
    )

    # joins, dedup, upsert
    q["j1_new_only"] = lambda spark, d: upsert.new_only(_arrived(spark, d), b.jobs(spark, d)).select(
        "url", "title", *upsert.RUN_ORDER
    )
    q["j2_upsert_fill_missing"] = lambda spark, d: _shown(_merged(spark, d))
    q["j2_merge_bucketed"] = j2_merge_bucketed
    q["j3_dedup_batch"] = lambda spark, d: upsert.dedup_batch(b.incoming(spark, d)).select(
        "url", "title", *upsert.RUN_ORDER
    )
    q["j4_upsert_counts"] = lambda spark, d: upsert.upsert_counts(_merged_blankness(spark, d))
    q["j5_skill_alias_lookup"] = lambda spark, d: b.raw_skills(spark, d).withColumn(
        "alias", skills.skill_alias(skills.skill_words(C("raw_skill")))
    )
    q["j6_display_alias_lookup"] = lambda spark, d: b.raw_skills(spark, d).withColumn(
        "skill", skills.normalize_skill(C("raw_skill"))
    ).withColumn("display_alias", skills.display_alias(C("skill")))
    q["j7_city_gazetteer_match"] = _jobs(
        lambda j: j.select("id", "location_text", text.gazetteer_match(C("location_text")).alias("known_city"))
    )
    q["j8_enrich_from_detail"] = lambda spark, d: _json(
        extract.enrich_from_pages(
            upsert.dedup_batch(extract.extract_cards(b.listing_pages(spark, d))),
            b.slim_detail_pages(spark, d), _ingest_ts(), b.with_detail_html(spark, d),
        ),
        "skills",
    )

    # aggregations
    q["a1_total_jobs"] = _jobs(counts.total_jobs)
    q["a2_count_filtered"] = _jobs(lambda j: search.count_filtered(j, search="remot", source="3-MEDIUM"))
    for column in ("source", "city", "contract_type", "seniority"):
        q[f"a3_value_counts_{column}"] = _jobs(lambda j, c=column: counts.value_counts(j, c))
    q["a4_work_mode_counts"] = _jobs(counts.work_mode_counts)
    q["a5_skill_counts"] = _jobs(counts.skill_counts)
    q["a6_salary_summary"] = _jobs(counts.salary_summary)
    q["a7_monthly_trend"] = _jobs(counts.monthly_trend)
    q["a8_english_distribution"] = _jobs(counts.english_distribution)
    q["a9_english_monthly_trend"] = _jobs(counts.english_monthly_trend)
    q["a10_ingest_stats"] = _jobs(counts.ingest_stats)
    q["a11_skill_month_counts"] = _jobs(counts.skill_month_counts)
    q["a12_skill_month_counts_all"] = _jobs(counts.skill_month_counts_all)
    q["a13_ingest_progress"] = _task_progress
    q["a13_task_status"] = _task_status
    q["a14_source_progress"] = lambda spark, d: progress.source_progress(b.progress(spark, d))
    q["a15_overview"] = _jobs(overview.overview)
    q["a15_overview_filtered"] = _jobs(lambda j: overview.overview(j, source="5-LOW", top_n=20))

    # sort, limit, top-k
    q["l1_page"] = _jobs(
        lambda j: search.newest_first(search.matching(j, source="2-HIGH"), 50, 100, j).select("id", "scraped_at", "title")
    )
    q["l2_search_jobs"] = _jobs(lambda j: _search_result(j))
    q["l3_list_recent"] = _jobs(lambda j: search.list_recent(j).select("id", "scraped_at", "source", "title", "city"))
    q["l4_top_k_per_dimension"] = _jobs(
        lambda j: counts.top_k(counts.ingest_stats(j), 10, "jobs", "value", per="metric")
    )
    q["l5_top_k_skills"] = lambda spark, d: counts.top_k(
        _months(spark, d).groupBy("category", "skill").agg(F.sum("count").alias("total")), 10, "total", "skill",
        per="category",
    )
    q["l6_top_cities"] = _jobs(counts.top_cities)
    q["l7_links_per_page"] = lambda spark, d: extract.extract_links(
        b.given(spark, d, "pages"), wanted="/", unwanted=[], base="https://pages.example",
        per_page=fixed.MICRODATA_LINKS_PER_PAGE,
    )
    q["l8_sorted_months"] = lambda spark, d: _json(
        _months(spark, d).groupBy("category", "skill").agg(F.array_sort(F.collect_list("month")).alias("months")),
        "months",
    )

    # time series
    q["w1_ordinal_index"] = lambda spark, d: series.ordinal_index(_months(spark, d))
    q["w2_linear_fit"] = lambda spark, d: series.linear_fit(series.ordinal_index(_months(spark, d)))
    q["w3_next_months"] = lambda spark, d: series.next_months(_months(spark, d), 12)
    q["w4_forecast_points"] = lambda spark, d: series.forecast_points(_months(spark, d), 3)
    q["w5_forecast_summary"] = lambda spark, d: series.forecast_summary(_months(spark, d), 3)
    q["w6_skill_forecast"] = lambda spark, d: _json(
        forecast.skill_forecast(_months(spark, d), 20, 6), "history", "forecast"
    )
    q["w7_demand_forecast"] = _jobs(lambda j: _json(forecast.demand_forecast(j), "history", "forecast"))
    q["w8_holdout_split"] = lambda spark, d: series.holdout_split(_months(spark, d), 2)
    q["w9_forecast_error"] = lambda spark, d: series.forecast_error(series.holdout_split(_months(spark, d), 2))
    q["w10_confidence_label"] = lambda spark, d: series.forecast_error(
        series.holdout_split(_months(spark, d), 6)
    ).withColumn("confidence_level", series.confidence_label(C("mape_pct")))
    q["w11_forecast_confidence"] = _jobs(forecast.forecast_confidence)

    # set operations
    q["u1_union_sources"] = lambda spark, d: upsert.union_sources(
        b.jobs(spark, d).select("url", "title", "company", "seniority"),
        b.incoming(spark, d).select("url", "title", "remote_type"),
    )
    q["u2_distinct_skills"] = _jobs(
        lambda j: j.select(
            "id", F.size("skills").alias("listed"), F.size(skills.normalize_skills(C("skills"))).alias("kept")
        )
    )

    # column rules
    q["x1_strip_accents"] = lambda spark, d: b.given(spark, d, "documents").select(
        "doc_id", text.strip_accents(C("text")).alias("folded")
    )
    per_skill = {
        "x2_normalize_skill": skills.normalize_skill,
        "x4_denormalize_skill": skills.denormalize_skill,
        "x5_format_skill": skills.format_skill,
        "x6_is_soft_skill": skills.is_soft_skill,
        "x7_skill_category": skills.skill_category,
    }
    for name, rule in per_skill.items():
        q[name] = lambda spark, d, rule=rule: b.raw_skills(spark, d).withColumn("out", rule(C("raw_skill")))
    q["x3_normalize_skills"] = _jobs(
        lambda j: j.select("id", F.to_json(skills.normalize_skills(C("skills"))).alias("skills"))
    )
    per_job = {
        "x8_detect_english": lambda: text.detect_english(C("title"), C("description"), C("location_text")),
        "x9_detect_work_mode": lambda: text.detect_work_mode(C("location_text"), C("contract_type")),
        "x10_normalize_location": lambda: text.normalize_location(C("location_text")),
        "x11_extract_city": lambda: text.extract_city(C("location_text")),
        "x12_month_key": counts.posting_month,
    }
    for name, rule in per_job.items():
        q[name] = _jobs(lambda j, rule=rule: j.select("id", rule().alias("out")))
    q["x13_backfill_derived"] = _jobs(lambda j: derive.backfill_derived(j).select("id", *derive.DERIVED))
    q["x14_changed_rows"] = _jobs(lambda j: derive.changed_rows(j).select("id", *derive.DERIVED))
    q["x15_parse_salary_single"] = _texts("salary_text", amount=parsing.parse_salary_single)
    q["x16_parse_salary_range"] = lambda spark, d: b.field_texts(spark, d).select(
        "id", "range_text", parsing.parse_salary_range(C("range_text")).alias("s")
    ).select("id", "range_text", "s.*")
    q["x17_split_company_contract"] = lambda spark, d: b.field_texts(spark, d).select(
        "id", parsing.split_company_contract(
            F.transform("card_texts", text.trim_spaces), C("title")
        ).alias("s")
    ).select("id", "s.*")
    q["x18_parse_publish_date"] = _texts("date_text", published_at=parsing.parse_publish_date)
    q["x19_parse_iso_timestamp"] = _texts(
        "iso_text", published_at=lambda c: parsing.parse_iso_timestamp(c, _ingest_ts())
    )
    q["x20_absolute_url"] = _texts("href", url=lambda c: parsing.absolute_url(c, fixed.MICRODATA_SITE_URL))
    q["x21_is_posting_link"] = _texts(
        "href",
        microdata_link=parsing.is_posting_link,
        card_link=lambda c: parsing.is_posting_link(c, fixed.CARD_LINK, []),
    )

    # page extraction
    q["h1_extract_cards"] = lambda spark, d: extract.extract_cards(b.listing_pages(spark, d))
    q["h2_extract_class_detail"] = lambda spark, d: _json(
        extract.extract_class_detail(b.detail_pages(spark, d)), "skills"
    )
    q["h3_extract_microdata"] = lambda spark, d: _json(
        extract.extract_microdata(b.microdata_pages(spark, d), _ingest_ts()), "skills"
    )
    q["h4_extract_links"] = lambda spark, d: extract.extract_links(b.microdata_pages(spark, d))
    q["h5_extract_skill_tags"] = lambda spark, d: b.detail_pages(spark, d).select(
        "page_id", F.to_json(pages.skill_tags("html")).alias("skills")
    )
    q["h6_work_mode_cascade"] = lambda spark, d: extract.microdata_work_modes(b.microdata_pages(spark, d)).union(
        extract.class_detail_work_modes(b.detail_pages(spark, d))
    )
    q["h7_find_city_text"] = lambda spark, d: extract.extract_class_detail(b.detail_pages(spark, d)).select(
        "page_id", "city"
    )
    q["h8_build_raw_postings"] = lambda spark, d: _json(_raw_postings(spark, d), "skills")

    # streams
    q["t1_ingest_stream"] = t1_ingest_stream
    q["t2_stream_dedup_by_url"] = t2_stream_dedup_by_url
    q["t3_stream_progress"] = t3_stream_progress
    q["t4_ingest_metrics"] = t4_ingest_metrics
    q["t4_stream_ingest_metrics"] = t4_stream_ingest_metrics
    return q | (llm.queries() if llm else {})


def _search_result(jobs: DataFrame) -> DataFrame:
    """A page with its total on every row."""
    total, page = search.search_jobs(jobs, search="engineer", limit=25, offset=50, city="CUCUTA")
    return page.select("id", "scraped_at", "title", total.select("total").scalar().alias("total"))


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB SQL, written from the rules and not from the Spark code."""
    return ORACLES | (llm.oracle_sql() if llm else {})


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: skill demand forecast."""
    return queries()["w7_demand_forecast"](spark, "/root/testdata/sf0.001")
