"""Merges, stores and appends in which descriptions take no part in shuffles."""

from pyspark.sql import functions as F
from plans import plan_of
from test_bucketed import now, without_broadcast

import __spark_entry__ as entry
from vacantis import schema
from vacantis.operators import extract, upsert
from vacantis.sources import bindings as b


def rows_of(df):
    return sorted(map(repr, df.select(schema.JOB_COLUMNS + ["change"]).collect()))


def tables(spark):
    """Stored postings with and without url, twice, with null, empty and full descriptions, and a batch."""
    none = spark.createDataFrame([], schema.JOBS_SCHEMA)
    texts = ["old", "", None]
    jobs = spark.createDataFrame(
        [(i, "a", "t", url, text) for i, (url, text) in enumerate((u, x) for u in ("u1", "u2", "u2", None, "") for x in texts)],
        "id long, source string, title string, url string, description string",
    )
    batch = spark.createDataFrame(
        [("u1", "b", "t", "new", "c"), ("u2", "b", "t", "", None), ("u3", "b", "t", "", None), ("u4", "b", "t", "x", None)],
        "url string, source string, title string, description string, company string",
    )
    return [none.drop(*drop).unionByName(df, allowMissingColumns=True) for df, drop in ((jobs, ()), (batch, ("id",)))]


def test_late_descriptions_give_the_same_merge(spark):
    jobs, batch = tables(spark)
    texts = jobs.select("id", "description")
    got = upsert.upsert_fill_missing(
        jobs.drop("description"), batch, now(), late=lambda df: df.join(texts, "id", "left"), laid=lambda df: df.repartition(3, "url")
    )
    assert rows_of(got) == rows_of(upsert.upsert_fill_missing(jobs, batch, now()))


def test_texts_are_joined_after_the_merge(spark, sf_dir):
    with without_broadcast(spark):
        joins = [x for x in plan_of(entry._merged(spark, sf_dir)).splitlines() if "Join" in x]
    assert "doc_slot" in joins[0]


def test_counts_need_no_text_in_a_shuffle(spark, sf_dir):
    jobs, batch = tables(spark)
    texts = jobs.select("id", "description")
    late = upsert.upsert_fill_missing(jobs.drop("description"), batch, now(), late=lambda df: df.join(texts, "id", "left"))
    whole = upsert.upsert_fill_missing(jobs, batch, now())
    assert upsert.upsert_counts(late).first() == upsert.upsert_counts(whole).first()
    with without_broadcast(spark):
        joins = [x for x in plan_of(entry.queries()["j4_upsert_counts"](spark, sf_dir)).splitlines() if "Join" in x]
    assert "doc_slot" in joins[0]


def test_postings_by_text_are_the_same_postings(spark, sf_dir):
    plain, by_text = b.jobs(spark, sf_dir).select(schema.JOB_COLUMNS), b.jobs_by_text(spark, sf_dir)
    assert by_text.exceptAll(plain).isEmpty() and by_text.count() == plain.count()


def test_rows_are_ordered_below_the_join_with_their_texts(spark, sf_dir):
    plan = plan_of(b.jobs_by_text(spark, sf_dir))
    assert "Sort [doc_slot" in plan


def test_pages_rendered_late_are_the_same_pages(spark, sf_dir):
    for whole, slim, late in (
        (b.detail_pages, b.slim_detail_pages, b.with_detail_html), (b.microdata_pages, b.slim_microdata_pages, b.with_microdata_html),
    ):
        plain, rendered = whole(spark, sf_dir).select("page_id", "url", "html"), late(spark, sf_dir)(slim(spark, sf_dir))
        rendered = rendered.select("page_id", "url", "html")
        assert rendered.exceptAll(plain).isEmpty() and rendered.count() == plain.count()


def test_postings_of_late_pages_are_the_same(spark):
    """Cards without page, urls fetched once and more often, pages without title, url or html."""
    stamp = F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))
    site = "https://www.magneto365.com/co/empleos/"
    card = ('<div class="magneto-ui-card-jobs_container"><a href="/co/empleos/{0}"><h2 class="text--big text--bold">T{0}</h2></a>'
            "<p>ACME | Fijo</p><p>Cali</p></div>")
    listing = spark.createDataFrame([(1, 0, 0, "".join(map(card.format, range(6)))), (2, 1, 0, card.format(1))], "page_id long, term_seq long, page_seq long, html string")
    detail = '<a class="header__company">C{0}</a><div class="JobOfferDetailContent_content">text {0}</div>'
    details = spark.createDataFrame(
        [(i, site + str(u), detail.format(i)) for i, u in ((1, 0), (2, 1), (3, 1), (4, 2))] + [(5, None, "x"), (6, site + "3", None), (None, site + "4", "x")],
        "page_id long, url string, html string",
    )
    micro = spark.createDataFrame(
        [(i, u, f"<h1 itemprop=title>{t}</h1><div itemprop=description>english {i}</div>") for i, u, t in (
            (1, "a", "A"), (2, "b", ""), (3, "b", "B"), (4, "b", "B2"), (5, "c", ""), (6, None, "N"), (7, None, "N"), (8, "", "E"))] + [(9, "d", None)],
        "page_id long, url string, html string",
    )

    def late(pages):
        texts = pages.select(F.col("page_id").alias("p"), F.col("url").alias("u"), "html")
        return lambda df: df.join(texts, (F.col("page_id") == F.col("p")) & (F.col("url") == F.col("u")), "left").drop("p", "u")

    def rows(df):
        return sorted(map(repr, df.collect()))

    cards = upsert.dedup_batch(extract.extract_cards(listing))
    before = rows(upsert.enrich_from_detail(cards, extract.extract_class_detail(details), stamp))
    assert len(before) == 6 and rows(extract.enrich_from_pages(cards, details, stamp)) == before
    known = details.where("page_id IS NOT NULL")
    got = extract.enrich_from_pages(cards, known.drop("html"), stamp, late(known))
    assert rows(got) == rows(upsert.enrich_from_detail(cards, extract.extract_class_detail(known), stamp))
    plain = upsert.dedup_batch(upsert.has_title_and_url(extract.extract_microdata(micro, stamp)), ("page_id",))
    assert [r.page_id for r in plain.orderBy("page_id").collect()] == [1, 3]
    for read in (extract.microdata_postings(micro, stamp), extract.microdata_postings(micro.drop("html"), stamp, late(micro))):
        assert rows(read) == rows(plain)


def test_pages_take_no_part_in_the_join_by_url(spark, sf_dir):
    for name in ("j8_enrich_from_detail", "h8_build_raw_postings"):
        with without_broadcast(spark):
            plan = plan_of(entry.queries()[name](spark, sf_dir)).splitlines()
        # below the reading of a page lies the join with its text, and only below that the joins by url
        depth = [i for i, x in enumerate(plan) if "ArrowEvalPython" in x]
        first_join = next(i for i, x in enumerate(plan) if i > depth[0] and "Join" in x)
        assert "doc_slot" in plan[first_join]


def test_counts_depend_on_blankness_alone(spark, sf_dir):
    jobs, batch = tables(spark)
    cut = upsert.upsert_fill_missing(upsert.only_blankness(jobs), upsert.only_blankness(batch), now())
    assert upsert.upsert_counts(cut).first() == upsert.upsert_counts(upsert.upsert_fill_missing(jobs, batch, now())).first()
    skills = [(None,), ([],), (["a"],)]
    df = spark.createDataFrame([(s, t) for (s,) in skills for t in (None, "", "text")], "skills array<string>, title string")
    got = [(r.skills, r.title) for r in upsert.only_blankness(df).collect()]
    assert got == [(s, t) for s in (None, [], []) for t in (None, "", "t")]
    counted, whole = entry.queries()["j4_upsert_counts"](spark, sf_dir), upsert.upsert_counts(entry._merged(spark, sf_dir))
    assert counted.first() == whole.first()
    plan = plan_of(counted)
    assert "left(text" in plan or "substr" in plan.lower()


def test_repeated_documents_repeat_no_posting(spark, sf_dir, tmp_path):
    for name in ("orders", "customer"):
        b.given(spark, sf_dir, name).limit(40).write.parquet(f"{tmp_path}/{name}.parquet")
    documents = b.given(spark, sf_dir, "documents")
    documents.union(documents).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("j8_enrich_from_detail", "h8_build_raw_postings"):
        got = entry.queries()[name](spark, str(tmp_path))
        assert got.count() == got.select("url").distinct().count() > 40
