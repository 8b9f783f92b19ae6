"""Binding of the given tables to the posting schema.

The text of each view runs unchanged in Spark SQL and in DuckDB, except for the
array constructor, which is a parameter. Every view covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantis.schema import JOBS_SCHEMA
from vacantis.session import in_order

GIVEN_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

LOCATIONS = [
    "Bogotá, Colombia", "Santiago de Cali", "Remoto - Colombia", "Híbrido Medellín",
    "California, USA", "Back office Lima", "São Paulo ,  Brasil", "Mexico City", None, "",
    "CUCUTA", "Teletrabajo", "Quito Presencial", "Itagüí", "Valencia, España", "Ciudad   Real",
]
TITLES = [
    "Backend Developer", "Desarrollador Full Stack", "Data Engineer (Advanced English)",
    "QA 100% remoto", "DevOps", "Frontend_React",
]
SNIPPETS = [
    "Requiere nivel B2 de inglés.", "No requiere inglés.", "English not required",
    "Must be able to speak English", "Trabajo en Bogota", "Inglés no es indispensable", None,
]
SKILLS = [
    "Node.js", "nodeJs", "React Native", "trabajoEnEquipo", "Comunicación efectiva", "Liderazgo",
    "APIs REST", "apiRest", "Power BI", "C++", "C#", "PostgreSQL", ".NET", "MongoDB", "JavaScript",
    "Javascript", "Resolución de problemas", "Pensamiento analítico", "html5 css3", "3D Max", "  ",
    "a B C", "WebSocket", "UI/UX implementation", None,
]


def _pick(expr: str, values: list[str | None]) -> str:
    branches = " ".join(
        f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None
    )
    return f"CASE CAST({expr} AS BIGINT) % {len(values)} {branches} END"


_LOC = _pick("o.o_custkey", LOCATIONS)

_DESCRIPTION = f"""CASE WHEN {_pick("o.o_orderkey", SNIPPETS)} IS NULL THEN d.text ELSE concat({_pick("o.o_orderkey", SNIPPETS)}, ' ', d.text) END AS description"""
_DOCUMENTS = "LEFT JOIN documents d ON d.doc_id = o.doc_slot\n"

# one row per order; customer and documents are left-joined so that no order is lost
JOBS = f"""
SELECT o.o_orderkey AS id, o.o_orderpriority AS source, {_pick("o.o_orderkey", TITLES)} AS title, c.c_name AS company,
  CASE WHEN o.o_orderkey % 8 = 0 THEN NULL ELSE {_LOC} END AS city,
  {_LOC} AS location_text,
  CASE o.o_orderkey % 5 WHEN 0 THEN 'Término indefinido' WHEN 1 THEN 'Full time' WHEN 2 THEN 'Remote contractor' WHEN 3 THEN '' END AS contract_type,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN '' END AS work_mode,
  CASE o.o_orderkey % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS english_required,
  CASE WHEN c.c_acctbal >= 0 THEN CAST(floor(c.c_acctbal) AS INT) * 1000 END AS salary_min,
  CASE WHEN o.o_orderstatus <> 'P' THEN CAST(floor(o.o_totalprice) AS INT) END AS salary_max,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'USD' ELSE 'COP' END AS currency,
  {_DESCRIPTION},
  CAST(NULL AS VARCHAR(10)) AS category,
  CASE o.o_orderstatus WHEN 'F' THEN 'senior' WHEN 'O' THEN 'junior' END AS seniority,
  CASE WHEN o.o_orderkey % 11 = 10 THEN NULL ELSE {{array}}(
    {_pick("o.o_orderkey", SKILLS)}, {_pick("o.o_custkey", SKILLS)}, {_pick("o.o_orderkey + o.o_custkey", SKILLS)},
    {_pick("floor(o.o_totalprice)", SKILLS)}, concat('Tool ', CAST(o.o_custkey AS VARCHAR(20)))) END AS skills,
  concat('https://jobs.example/', CAST(o.o_orderkey AS VARCHAR(20))) AS url,
  CASE WHEN o.o_orderkey % 10 <> 0 THEN o.o_orderdate END AS published_at,
  CASE WHEN o.o_orderkey % 100 <> 50 THEN o.o_orderdate + INTERVAL 3 DAY END AS scraped_at
FROM (SELECT *, o_orderkey % (SELECT count(*) FROM documents) AS doc_slot FROM orders) o
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
{_DOCUMENTS}"""

# the same without the texts, which ``with_texts`` adds
SLIM_JOBS = JOBS.replace(_DESCRIPTION, f"{_pick('o.o_orderkey', SNIPPETS)} AS snippet, o.doc_slot").replace(_DOCUMENTS, "")

# one incoming posting per line item: repeated urls inside the batch, urls known to the
# stored table, new urls, missing urls and titles, blank fields, the legacy column
INCOMING = f"""
SELECT l.l_linenumber AS term_seq, l.l_suppkey AS page_seq, l.l_partkey AS pos,
  CASE WHEN l.l_returnflag = 'R' THEN 'site-a' ELSE 'site-b' END AS source,
  CASE WHEN l.l_partkey % 31 = 0 THEN '' ELSE concat({_pick("l.l_partkey", TITLES)}, ' v', CAST(l.l_linenumber AS VARCHAR(9))) END AS title,
  CASE WHEN l.l_suppkey % 5 <> 0 THEN concat('Company ', CAST(l.l_suppkey AS VARCHAR(20))) END AS company,
  {_pick("l.l_partkey", LOCATIONS)} AS city, {_pick("l.l_suppkey", LOCATIONS)} AS location_text,
  CASE l.l_partkey % 4 WHEN 0 THEN 'Contract X' WHEN 1 THEN '' END AS contract_type,
  CASE WHEN l.l_partkey % 3 = 0 THEN 'Legacy contract' END AS remote_type,
  CASE l.l_suppkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN '' END AS work_mode,
  CASE l.l_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS english_required,
  CASE WHEN l.l_linenumber <> 2 THEN CAST(l.l_quantity AS INT) END AS salary_min,
  CASE WHEN l.l_linenumber <> 3 THEN CAST(l.l_quantity AS INT) * 2 END AS salary_max,
  CASE WHEN l.l_linestatus = 'O' THEN 'USD' END AS currency,
  concat('new text ', CAST(l.l_partkey AS VARCHAR(20))) AS description,
  CASE WHEN l.l_partkey % 7 = 0 THEN NULL ELSE {{array}}({_pick("l.l_partkey", SKILLS)}, {_pick("l.l_suppkey", SKILLS)}) END AS skills,
  CASE WHEN l.l_partkey % 97 = 0 THEN NULL WHEN l.l_partkey % 89 = 0 THEN ''
    ELSE concat('https://jobs.example/', CAST(l.l_orderkey * 2 AS VARCHAR(20))) END AS url,
  l.l_shipdate AS published_at, l.l_shipdate + INTERVAL 1 DAY AS scraped_at
FROM lineitem l
"""

PROGRESS = """
SELECT user_id % 20 AS task_id, event_type AS source, ts, event_id,
  CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 10 < 5 THEN 'completed' ELSE 'running' END AS status,
  CASE WHEN user_id % 20 = 7 THEN 0 ELSE CAST(floor(value) AS INT) END AS processed_jobs,
  CASE WHEN user_id % 20 = 7 THEN 0 ELSE CAST(floor(value) AS INT) + CAST(event_id % 50 AS INT) END AS total_jobs,
  CAST(floor(value / 2) AS INT) AS saved_jobs,
  concat('step ', CAST(event_id AS VARCHAR(20))) AS message
FROM events
"""

_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SHOWN = _ESCAPED.format("coalesce(j.description, '')")
if any(c in snippet for snippet in SNIPPETS if snippet for c in "&<>"):
    raise ValueError("snippets go into pages as they are: only documents are escaped")


def _of_escaped(text: str) -> str:
    """A view of pages over postings whose texts are escaped already."""
    return text.replace(_SHOWN, "coalesce(j.description, '')")


# microdata pages, one per posting; odd ones nest their markup
_MICRODATA_KEYS = "j.id AS page_id, concat('https://www.getonbrd.com/empleos/', CAST(j.id AS VARCHAR(20))) AS url"
_MICRODATA_HTML = f"""concat('<html><head><script>var x = "<h1 itemprop=&quot;title&quot;>no</h1>";</script></head><body><!-- <h1 itemprop="title">old</h1> -->',
   '<h1 class="gb-title" itemprop="title"> ', j.title, ' </h1>',
   CASE WHEN j.id % 9 = 0 THEN '' ELSE concat('<a href="/companies/x" class="x header__company y"><strong>', coalesce(j.company, ''), '</strong></a>') END,
   '<span itemprop="jobLocation"><div itemprop="address">', coalesce(j.location_text, ''), '</div>',
   CASE WHEN j.id % 5 = 0 THEN '<b>Hybrid</b>' ELSE '' END, '</span>',
   CASE WHEN j.id % 6 = 1 THEN '<p class="mode"><i class="fa icon-wifi"></i> Trabajo <b>remoto</b></p>' ELSE '' END,
   CASE WHEN j.id % 7 = 2 THEN '<div class="location-tooltip-content">Presencial en oficina</div>' ELSE '' END,
   CASE WHEN j.id % 4 = 3 THEN concat('<span itemprop="employmentType">', coalesce(j.contract_type, ''), '</span>')
     ELSE concat('<span itemprop="employmentType" content="', coalesce(j.contract_type, ''), '">z</span>') END,
   CASE j.id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('<div itemprop="baseSalary">$', CAST(coalesce(j.salary_min, 0) AS VARCHAR(20)), ' net</div>')
     WHEN 2 THEN concat('<div itemprop="baseSalary"><span>$', CAST(coalesce(j.salary_min, 0) AS VARCHAR(20)), '</span> - <span>$99.999.999.999</span> COP</div>')
     ELSE concat('<div itemprop="baseSalary">$', CAST(coalesce(j.salary_min, 0) AS VARCHAR(20)), ' - $', CAST(coalesce(j.salary_max, 0) AS VARCHAR(20)), ' USD</div>') END,
   CASE WHEN j.id % 2 = 0 THEN concat('<div itemprop="description"><p>', {_SHOWN}, '</p></div>')
     ELSE concat('<div id="job-body"><div class="in"><p>', {_SHOWN}, '</p></div><div>Bye</div></div>') END,
   '<div itemprop="skills"><a class="gb-tags__item">Node.js</a><div><a class="gb-tags__item x">', {_pick("j.id", ["Power BI", "C++", "Liderazgo", "SQL"])}, '</a></div></div><a class="gb-tags__item">outside</a>',
   CASE WHEN j.id % 3 = 0 THEN '<time itemprop="datePosted">soon</time>' WHEN j.id % 3 = 1 THEN '<time itemprop="datePosted" datetime="2024-05-17T10:00:00Z">17 mayo</time>'
     ELSE '<time itemprop="datePosted" datetime="2024-05-17T10:00:00-05:00">17 mayo</time>' END,
   '<a href="/empleos/backend-', CAST(j.id AS VARCHAR(20)), '">one</a><a class="t" href="/empleos/tag/python">two</a><a href="/empleos/ciudad/cali">three</a>',
   '<a href="https://www.getonbrd.com/empleos/data-', CAST(j.id AS VARCHAR(20)), '">four</a><a href="/blog">five</a>',
   '</body></html>') AS html"""
MICRODATA_PAGES = f"""
SELECT {_MICRODATA_KEYS},
  {_MICRODATA_HTML}
FROM jobs j
"""


def _card(key: str) -> str:
    url = f"concat('/co/empleos/', CAST({key} AS VARCHAR(20)))"
    return f"""concat('<div class="mg magneto-ui-card-jobs_container x"><div><a class="l" href="',
     CASE WHEN {key} % 4 = 0 THEN 'https://www.magneto365.com' ELSE '' END,
     CASE WHEN {key} % 13 = 12 THEN '/otros' ELSE {url} END, '"><h2 class="text text--big text--bold">', {_pick(key, TITLES[:5] + [""])}, '</h2></a></div><p>',
     CASE WHEN {key} % 3 = 0 THEN 'Plain company' ELSE concat('ACME ', CAST({key} % 50 AS VARCHAR(20)), ' | ', {_pick(key, ["Término fijo", "Remoto", "Indefinido | x"])}) END,
     '</p><p>', coalesce({_pick(key, LOCATIONS)}, ''), '</p><span>', {_pick(key, ["Salario $ 2.500.000 mensual", "A convenir", "$ confidencial", "sin dato"])}, '</span></div>')"""


# listing pages: three cards each, the same posting shows up on several pages
LISTING_PAGES = f"""
SELECT o_orderkey AS page_id, o_orderkey % 7 AS term_seq, o_orderkey AS page_seq, o_orderdate AS fetched_at,
  concat('<html><body><div class="list">', {_card("o_orderkey")}, {_card("o_custkey")}, {_card("(o_orderkey + o_custkey)")}, '</div></body></html>') AS html
FROM orders
"""

# class-marked detail pages of the same site
_DETAIL_KEYS = "j.id AS page_id, concat('https://www.magneto365.com/co/empleos/', CAST(j.id AS VARCHAR(20))) AS url, j.title AS title"
_DETAIL_HTML = f"""concat('<html><body><span class="a header_publish-date b">Fecha de publicación ',
   CASE WHEN j.id % 6 = 5 THEN 'pendiente' ELSE '2024-05-17' END, '</span>',
   CASE WHEN j.id % 4 = 1 THEN '' ELSE concat('<a class="x header__company y">', coalesce(j.company, ''), ' <b>SAS</b></a>') END,
   CASE WHEN j.id % 3 = 2 THEN '' ELSE concat('<span class="contract-type">| ', coalesce(j.contract_type, ''), '</span>') END,
   '<span class="a summary_label">', coalesce(j.location_text, ''), '</span>',
   CASE WHEN j.id % 5 = 4 THEN '<span class="a summary_label">Presencial</span>' ELSE '' END,
   CASE WHEN j.id % 5 = 3 THEN '<span class="a summary_label">$ a convenir</span>' ELSE '' END,
   CASE WHEN j.id % 7 = 6 THEN '' ELSE concat('<span class="a summary_label">Salario $ ', CAST(coalesce(j.salary_min, 0) AS VARCHAR(20)), '.000 mensual</span>') END,
   CASE WHEN j.id % 8 = 7 THEN '' ELSE concat('<div class="JobOfferDetailContent_content__z"><div><p>', {_SHOWN}, '</p></div><p>Fin</p></div>') END,
   CASE j.id % 4 WHEN 0 THEN '<span class="skill_name">Node.js</span><span class="x skill_name">Power BI</span>'
     WHEN 1 THEN '<span data-skill="1">SQL</span><span data-skill="2"> </span>'
     WHEN 2 THEN '<div class="Skills"><div class="skill">Scrum</div></div><div class="skill-note">esta es una nota muy larga que no es una habilidad tecnica</div>'
     ELSE '' END,
   '</body></html>') AS html"""
DETAIL_PAGES = f"""
SELECT {_DETAIL_KEYS},
  {_DETAIL_HTML}
FROM jobs j
"""


# short texts for the field rules, one row per order
FIELD_TEXTS = f"""
SELECT o_orderkey AS id, {_pick("o_orderkey", TITLES)} AS title,
  CASE o_orderkey % 6 WHEN 0 THEN concat('Salario $ ', CAST(o_custkey AS VARCHAR(20)), '.500 mensual') WHEN 1 THEN 'A convenir'
    WHEN 2 THEN concat('Pago ', CAST(o_custkey AS VARCHAR(20))) WHEN 3 THEN '$ confidencial' WHEN 4 THEN concat('$99.', CAST(o_orderkey AS VARCHAR(20)), '.999.999') END AS salary_text,
  CASE o_orderkey % 6 WHEN 0 THEN concat('$', CAST(o_custkey AS VARCHAR(20)), ',000 - $', CAST(o_custkey * 2 AS VARCHAR(20)), '.000 USD') WHEN 1 THEN concat('$', CAST(o_custkey AS VARCHAR(20)))
    WHEN 2 THEN concat('.,. - ', CAST(o_custkey AS VARCHAR(20))) WHEN 3 THEN concat(CAST(o_custkey AS VARCHAR(20)), ' a 99.999.999.999') WHEN 4 THEN '' END AS range_text,
  {{array}}('Publicada hoy', {_pick("o_orderkey", TITLES)}, concat({_pick("o_orderkey", TITLES)}, ' | no'),
    CASE WHEN o_orderkey % 4 <> 0 THEN concat(' ACME ', CAST(o_custkey AS VARCHAR(20)), ' | Fijo | x ') ELSE 'nada' END, 'Otra | Indefinido') AS card_texts,
  CASE o_orderkey % 4 WHEN 0 THEN concat('Fecha de publicación ', substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10)) WHEN 1 THEN 'Fecha 2024-13-45' WHEN 2 THEN 'ayer' END AS date_text,
  CASE o_orderkey % 6 WHEN 0 THEN concat(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), 'T10:20:30Z') WHEN 1 THEN concat(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), 'T22:15:00-05:00')
    WHEN 2 THEN substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) WHEN 3 THEN 'soon' WHEN 4 THEN concat(substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), ' 08:00:00.250+05:30') END AS iso_text,
  CASE o_orderkey % 6 WHEN 0 THEN concat('/empleos/backend-', CAST(o_orderkey AS VARCHAR(20))) WHEN 1 THEN 'https://www.getonbrd.com/empleos/x' WHEN 2 THEN '/empleos/tag/python'
    WHEN 3 THEN '/empleos/ciudad/cali' WHEN 4 THEN concat('/co/empleos/', CAST(o_orderkey AS VARCHAR(20))) ELSE '/blog' END AS href
FROM orders
"""


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give an input with fewer splits than cores one partition per core.

    Large tables come with enough splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _view(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run a view text over DataFrames, named only for the time of the call."""
    names = {}
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
        names[name] = frame
    try:
        return spark.sql(text.replace("{array}", "array"))
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def jobs(spark: SparkSession, sf_dir: str, escaped: bool = False) -> DataFrame:
    """Stored postings; ``escaped`` ones hold texts as pages do, escaped once and not for each page of a text."""
    tables = {n: given(spark, sf_dir, n) for n in ("customer", "documents")}
    if escaped:
        tables["documents"] = tables["documents"].withColumn("text", F.expr(_ESCAPED.format("text")))
    return _view(spark, JOBS, orders=spread(given(spark, sf_dir, "orders")), **tables)


def slim_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jobs`` without ``description``; ``snippet`` and ``doc_slot`` stand for it."""
    tables = {n: given(spark, sf_dir, n) for n in ("customer", "documents")}
    return _view(spark, SLIM_JOBS, orders=spread(given(spark, sf_dir, "orders")), **tables)


def with_texts(
    spark: SparkSession, sf_dir: str, letters: int | None = None, once: bool = False, escaped: bool = False
) -> Callable[[DataFrame], DataFrame]:
    """Adds ``description`` to rows of ``slim_jobs``, whatever has been joined to them or dealt out since.

    So texts, nearly all of the bytes of a posting, take no part in the shuffles and sorts before. With ``letters``
    documents give no more than their first ones; ``once`` takes one document of each ``doc_id``, so that no row is repeated;
    ``escaped`` texts are as pages hold them.
    """
    text = F.expr(_ESCAPED.format("text")) if escaped else F.col("text") if letters is None else F.left("text", F.lit(letters))

    def add(slim: DataFrame) -> DataFrame:
        documents = given(spark, sf_dir, "documents")
        if once:
            nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
            documents = documents.where("doc_id IS NOT NULL").select("doc_id", "text", nth.alias("_nth")).where("_nth = 1")
        texts = documents.select(F.col("doc_id").alias("doc_slot"), text.alias("_text"))
        snippet, own = F.col("snippet"), F.col("_text")
        return slim.join(texts, "doc_slot", "left").withColumn(
            "description", F.when(snippet.isNull(), own).otherwise(F.concat(snippet, F.lit(" "), own))
        ).drop("doc_slot", "snippet", "_text")

    return add


def jobs_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jobs``, in each partition ordered by document before texts are added: equal texts lie side by side,
    where the codec of a file sees them."""
    slim = in_order(slim_jobs(spark, sf_dir), "doc_slot")
    return with_texts(spark, sf_dir)(slim).select(*JOBS_SCHEMA.names)


def incoming_of(lineitem: DataFrame) -> DataFrame:
    return _view(lineitem.sparkSession, INCOMING, lineitem=lineitem)


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incoming_of(spread(given(spark, sf_dir, "lineitem")))


def progress_of(events: DataFrame) -> DataFrame:
    return _view(events.sparkSession, PROGRESS, events=events)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_of(spread(given(spark, sf_dir, "events")))


def declared_of(states: DataFrame) -> DataFrame:
    """(task_id, source) of (task, source) states, and for some tasks one that has sent no event."""
    seen = states.select("task_id", "source").distinct()
    silent = seen.where("task_id % 5 = 3").select("task_id", F.lit("archive").alias("source"))
    return seen.union(silent.distinct())


def declared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, source): those of the events, and for some tasks one that has sent none."""
    return declared_of(progress(spark, sf_dir))


def microdata_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, _of_escaped(MICRODATA_PAGES), jobs=jobs(spark, sf_dir, escaped=True))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, LISTING_PAGES, orders=spread(given(spark, sf_dir, "orders")))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, _of_escaped(DETAIL_PAGES), jobs=jobs(spark, sf_dir, escaped=True))


# what a page is rendered from, but for its text
_PAGE_PARTS = "id title company location_text contract_type salary_min salary_max snippet doc_slot".split()


def _slim_pages(spark: SparkSession, sf_dir: str, keys: str) -> DataFrame:
    """Pages without ``html``; ``_parts`` stand for it."""
    parts = slim_jobs(spark, sf_dir).select(*_PAGE_PARTS, F.lit(True).alias("is_page"))
    return _view(spark, f"SELECT {keys}, struct(j.*) AS _parts FROM jobs j", jobs=parts)


def _rendered(spark: SparkSession, sf_dir: str, html: str) -> Callable[[DataFrame], DataFrame]:
    """Adds ``html`` to rows of slim pages, whatever has been joined to them since; NULL where a row came without a page."""

    def add(pages: DataFrame) -> DataFrame:
        held = F.struct(*[c for c in pages.columns if c != "_parts"]).alias("_held")
        # rows without a page need no text; their url spreads them over the tasks
        nowhere = -1 - F.pmod(F.xxhash64("_held.url"), F.lit(1 << 20))
        parts = pages.select(held, "_parts.*").withColumn("doc_slot", F.when(F.col("is_page"), F.col("doc_slot")).otherwise(nowhere))
        # which page of a url counts is settled by now
        texts = with_texts(spark, sf_dir, once=True, escaped=True)(parts).alias("j")
        return texts.select("_held.*", F.when(F.col("is_page"), F.expr(_of_escaped(html))).alias("html"))

    return add


def slim_microdata_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``microdata_pages`` without ``html``, which ``with_microdata_html`` adds."""
    return _slim_pages(spark, sf_dir, _MICRODATA_KEYS)


def with_microdata_html(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    return _rendered(spark, sf_dir, _MICRODATA_HTML)


def slim_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``detail_pages`` without ``html``, which ``with_detail_html`` adds."""
    return _slim_pages(spark, sf_dir, _DETAIL_KEYS)


def with_detail_html(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    return _rendered(spark, sf_dir, _DETAIL_HTML)


def field_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, FIELD_TEXTS, orders=spread(given(spark, sf_dir, "orders")))


def raw_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per array element of the stored skills."""
    return jobs(spark, sf_dir).select(
        F.col("id").alias("job_id"), F.posexplode("skills").alias("pos", "raw_skill")
    )
