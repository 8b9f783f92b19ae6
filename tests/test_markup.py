"""Element extraction on nested and irregular markup."""

import html
import random
import time

import pytest
from pyspark.sql import functions as F

from vacantis import fixed_values as fixed
from vacantis.functions import markup as m
from vacantis.functions import pages
from vacantis.functions.pages import Page, equals, holds
from vacantis.operators import extract
from vacantis.sources import bindings

PAGE = """<!-- <h1 itemprop="title">old</h1> --><script>"<h1 itemprop='title'>no</h1>"</script>
<H1 Class='a b' itemprop=title> Caf&eacute; &amp; T&#233; &#x20AC; &bogus; </H1>
<div class="box outer"><div class="in">one<br>two</div><div/>three</div>
<p><span>x</span> <b>Trabajo</b> <i class="fa icon-wifi"></i> remoto</p>
<meta itemprop="employmentType" content="Full">
<div class="skill"><div class="Skill-in">Scrum</div></div><div class="box">open end"""


def test_first_element_and_references():
    page = Page(PAGE)
    assert page.joined(page.first(None, "itemprop", equals("title")), " ") == "Café & Té € &bogus;"


def test_nested_element_is_kept_whole():
    page = Page(PAGE)
    assert page.joined(page.first("div", "class", holds("box")), "|") == "one|two|three"


def test_all_elements_include_nested_and_unclosed(spark):
    page = Page(PAGE)
    assert [page.joined(e, "|") for e in page.elements("div", "class", holds("box"))] == ["one|two|three", "open end"]
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    assert {r.page_id: r.s for r in df.select("page_id", pages.skill_tags("html").alias("s")).collect()} == {1: ["Scrum", "Scrum"], 2: None, 3: None}


def test_parent_of_icon():
    page = Page(PAGE)
    assert page.joined(page.around(page.first("i", "class", holds("icon-wifi"))), " ") == "x Trabajo remoto"


def test_absent_and_void_elements():
    page = Page(PAGE)
    assert page.joined(page.first(None, "itemprop", equals("zzz")), "") is None
    meta = page.first(None, "itemprop", equals("employmentType"))
    assert page.joined(meta, "") == "" and page.attributes(meta[0])["content"] == "Full"


@pytest.mark.parametrize("tag, text", [
    ("<h1 itemprop=title>", "Dev"), ("<h1 data-x='a > b' itemprop=title>", "Dev"), ('<h1 itemprop="title" data-x="a > b">', "Dev"),
    ("<H1 ITEMPROP = 'title' x>", "Dev"), ("<h1 data-itemprop=title>", None), ("<h1 x='itemprop=title'>", None),
    ("<h1 itemprop=title itemprop=other>", "Dev"), ("<h1 itemprop=other itemprop=title>", None), ('<h1 itemprop="title" y="open>', "Dev"),
])
def test_attributes_in_all_spellings(spark, tag, text):
    df = spark.createDataFrame([(1, "u", f"<p>{tag}Dev</h1></p>")], "page_id long, url string, html string")
    assert extract.extract_microdata(df, F.lit(None).cast("timestamp_ntz")).first()["title"] == text


@pytest.mark.parametrize("container, link", [
    ('<div data-x="a > b" class="magneto-ui-card-jobs_container">', '<a href="/co/empleos/1">'),
    ("<div class='x magneto-ui-card-jobs_container' y='>'>", "<a title='a > b' href=/co/empleos/1>"),
    ("<DIV CLASS=magneto-ui-card-jobs_container>", '<A data-href="/co/empleos/2" HREF = "/co/empleos/1">'),
])
def test_cards_with_a_bracket_in_a_value(spark, container, link):
    html = f"""{container}{link}<h2 title="1 > 0" class="text--big text--bold">Dev</h2></a><p>ACME | Fijo</p></div>"""
    rows = extract.extract_cards(spark.createDataFrame([(1, 0, 0, html)], "page_id long, term_seq long, page_seq long, html string")).collect()
    assert [(r.url, r.title, r.company) for r in rows] == [("https://www.magneto365.com/co/empleos/1", "Dev", "ACME")]


def test_elements_end_with_the_card_that_holds_them():
    page = Page("<div class=card><p class=t>open <div class=card><p class=t>two</p></div> tail</div> after")
    cards = list(page.elements("div", "class", holds("card")))
    assert [page.plain(page.first("p", "class", holds("t"), inside=c)) for c in cards] == ["open two tail", "two"]


def test_time_follows_the_length_of_a_page():
    def seconds(n):
        page = "<html>" + "<div class=skill><span class=summary_label>word <b>x</b></span></div>" * n + "<p>open" * n
        start = time.process_time()
        found = pages._detail(Page(page))
        return time.process_time() - start, len(found["labels"])

    assert seconds(200)[1] == 200
    (short, _), (long, n) = min(seconds(1000), seconds(1000)), min(seconds(8000), seconds(8000))
    assert n == 8000 and long < 16 * short  # 8 times the length


def test_long_page_is_read_to_its_end():
    page = Page(f'<div itemprop="description">{"<p>word</p>" * 20000}<div>end</div></div>tail')
    got = page.joined(page.first(None, "itemprop", equals("description")), " ")
    assert got.count("word") == 20000 and got.endswith("end")


def test_first_card_of_a_url_decides_on_its_page(spark):
    def card(href, title):
        return (f'<div class="magneto-ui-card-jobs_container"><a href="{href}">'
                f'<h2 class="text--big text--bold">{title}</h2></a><p>ACME | Fijo</p></div>')

    html = card("/co/empleos/1", "") + card("/co/empleos/1", "Late") + card("/co/empleos/2", "B") + card("/blog", "C")
    pages = spark.createDataFrame([(1, 0, 0, html)], "page_id long, term_seq long, page_seq long, html string")
    got = extract.extract_cards(pages).collect()
    assert [(r["title"], r["company"], r["contract_type"]) for r in got] == [("B", "ACME", "Fijo")]


@pytest.mark.parametrize("text, want", [
    ("&#9999999; &#xFFFFFF; &#xD800; &#0;", "\ufffd \ufffd \ufffd \ufffd"), ("&#150;&#x80;", "\u2013\u20ac"), ("&#00000038;&#38x", "&&x"),
    ("&plus;&lbrack;a&nbsp b&copyx", "+[a\xa0 b\xa9x"), ("&zzz; & &; &#; &#x;", "&zzz; & &; &#; &#x;"), ("&AMP;lt;", "&lt;"),
    ("&#99999999999999999999999999;", "\ufffd"), ("&notit; &notin;", "\xacit; \u2209"),
])
def test_references(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(m.unescape(F.col("t"))).first()[0]
    assert got == want == html.unescape(text)


def test_links_in_all_spellings(spark):
    page = """<a href=/empleos/1>x</a><A title="a > b" HREF='/empleos/2'>y</A><a title="href='/empleos/9'" href = "/empleos/3?a&amp;b">
    <a class=c href=/empleos/4/>z</a><a name=none>t</a><abbr href=/empleos/5>""" + "<a " + "x " * 50_000 + "href=/empleos/6>"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = [r.url for r in extract.extract_links(pages, "/empleos/", [], "https://s.example").orderBy("pos").collect()]
    assert got == [f"https://s.example/empleos/{x}" for x in ("1", "2", "3?a&b", "4/", "6")]


def test_equal_tags_of_pages_are_read_once():
    known = {}
    one, two = Page("<p class='a'>x</p>", known), Page("<b></b><p class='a'>y<br></p>", known)
    assert one.tags[0] is two.tags[2] and one.attributes(0) == {"class": "a"}


def test_both_ways_to_cut_a_page_agree():
    draw = random.Random(8)
    parts = ["<p class=a>", "</p>", "<P Class='A'>", "<br>", "<div/>", "<a href=x/>", "<i id=a/ >", "< b>", "<", ">", "'", '"', "<!x>", "<! 'y>", "<1>",
             "</>", "<p '>", "<p 'a>b'>", '<p x="1" x=2 y>', "text", "&amp;", "<p", "</p x='>'>", "<!-- <p> -->", "<script>'<p>'</script>"]
    quick = 0
    for _ in range(3000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 8)))
        page, plain = Page(text), Page("")
        plain._cut_by_pattern(pages.HIDDEN.sub("", text))
        assert (page.tags, page.pieces) == (plain.tags, plain.pieces), text
        quick += Page("")._cut_at_brackets(text, {})
    assert quick > 300


def test_work_modes_alone_are_those_of_whole_extraction(spark, sf_dir):
    stamp = F.lit(None).cast("timestamp_ntz")
    for given, whole, alone in (
        (bindings.microdata_pages, lambda p: extract.extract_microdata(p, stamp), extract.microdata_work_modes),
        (bindings.detail_pages, extract.extract_class_detail, extract.class_detail_work_modes),
    ):
        html = given(spark, sf_dir)
        want = whole(html).select("page_id", "work_mode").collect()
        assert sorted(map(tuple, alone(html).collect())) == sorted(map(tuple, want)) and want


def test_work_mode_of_a_description(spark):
    texts = ["x H\u00cdBRIDO y", "OFFICE", "remot", "Hybr\u0131d", "tele REMOTO office", ""]
    html = [(i, "u", f'<div class="{fixed.DETAIL_TEXT_CLASS}"><p>{t}</p></div>') for i, t in enumerate(texts)]
    got = extract.class_detail_work_modes(spark.createDataFrame(html, "page_id long, url string, html string")).collect()
    assert [r.work_mode for r in sorted(got)] == ["hybrid", "onsite", None, None, "remote", None]


def test_texts_are_escaped_below_the_join(spark, sf_dir):
    for pages_of in (bindings.microdata_pages, bindings.detail_pages):
        plan = pages_of(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("Join LeftOuter, (doc_id", 1) if "Join LeftOuter, (doc_id" in plan else plan.split("Join LeftOuter", 1)
        assert "replace(" not in above and "replace(" in below


def test_pages_equal_their_view(spark, sf_dir):
    rows = spark.createDataFrame(
        [(i, "a < b & c > d &amp;" if i % 3 else None, f"t{i}") for i in range(40)], "id long, description string, title string"
    ).selectExpr("*", "'c' AS company", "'l' AS location_text", "'k' AS contract_type", "1 AS salary_min", "2 AS salary_max")
    shown = rows.withColumn("description", F.expr(bindings._ESCAPED.format("description")))
    for view in (bindings.MICRODATA_PAGES, bindings.DETAIL_PAGES):
        assert bindings._of_escaped(view) != view
        want = bindings._view(spark, view, jobs=rows).collect()
        assert bindings._view(spark, bindings._of_escaped(view), jobs=shown).collect() == want
