"""Batch dedup and merge of incoming postings into the stored table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantis.functions.skills import normalize_skills
from vacantis.functions.text import non_empty
from vacantis.schema import JOBS_SCHEMA
from vacantis.session import in_one_task, stored_by

TEXT_FIELDS = [
    "title", "company", "city", "location_text", "contract_type", "work_mode", "currency", "description",
]
TYPED_FIELDS = ["english_required", "salary_min", "salary_max", "published_at"]
FILLED = TEXT_FIELDS + TYPED_FIELDS + ["skills"]
RUN_ORDER = ("term_seq", "page_seq", "pos")


def union_sources(*batches: DataFrame) -> DataFrame:
    """Postings of several pages, terms or sources; a missing column is NULL."""
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch, allowMissingColumns=True)
    return out


def has_title_and_url(df: DataFrame) -> DataFrame:
    return df.where((F.col("url") != "") & (F.col("title") != ""))


def dedup_batch(df: DataFrame, order: tuple[str, ...] = RUN_ORDER) -> DataFrame:
    """First row of each url in run order; rows without url are dropped.

    Each task keeps one row per url before the shuffle (window group limit), so a url
    with very many copies does not gather in one task.
    """
    first = W.partitionBy("url").orderBy(*order)
    return (
        df.where(F.col("url") != "")
        .withColumn("_nth", F.row_number().over(first))
        .where("_nth = 1")
        .drop("_nth")
    )


def new_only(incoming: DataFrame, existing: DataFrame, meet: str | None = None) -> DataFrame:
    """Incoming rows whose url is not stored yet.

    The stored urls are first cut down to those of the batch: with a small batch Spark
    broadcasts its urls and the big table is read without being shuffled. ``meet`` is a hint for both joins.
    """
    urls = incoming.select("url").distinct()
    known = existing.select("url").join(urls.hint(meet) if meet else urls, "url", "left_semi")
    return incoming.join(known.hint(meet) if meet else known, "url", "left_anti")


def _stored_skills(skills: Column) -> Column:
    normalized = normalize_skills(skills)
    return F.when(F.size(normalized) > 0, normalized)


def as_new(incoming: DataFrame, ingest_ts: Column) -> DataFrame:
    """Incoming rows in table shape; the legacy contract column is a fallback."""
    contract = [c for c in ("contract_type", "remote_type") if c in incoming.columns]
    values = {
        "contract_type": F.coalesce(*[F.col(c) for c in contract]),
        "skills": _stored_skills(F.col("skills")),
        "scraped_at": F.coalesce(F.col("scraped_at"), ingest_ts),
        "id": F.col("id") if "id" in incoming.columns else F.xxhash64("url"),
        "category": F.lit(None),
        "seniority": F.lit(None),
    }
    return incoming.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in JOBS_SCHEMA]
    )


def _blank(c: Column, text: bool) -> Column:
    return non_empty(c).isNull() if text else c.isNull()


# Rows of a batch from which it is not broadcast, and up to which a bucket of it is held in a hash table by a task.
BROADCAST_ROWS, HASHED_ROWS = 100_000, 2_000_000


def _beside_unsorted(batch: DataFrame, buckets: int) -> DataFrame:
    """A large stored batch is met by hash in each bucket: a sort would bring the stored texts to disk, and out of their order."""
    return batch.hint("shuffle_hash") if BROADCAST_ROWS < batch.count() <= buckets * HASHED_ROWS else batch


def stored_batch(incoming: DataFrame) -> DataFrame:
    """A batch stored in as many buckets of its url as a shuffle has tasks."""
    return stored_by(incoming, "url", int(incoming.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch")


def upsert_apart(
    parts: Sequence[tuple[DataFrame, DataFrame]], rows: int, ingest_ts: Column | None = None, skip_existing: bool = False
) -> DataFrame:
    """``upsert_fill_missing`` of (stored rows, batch) of each bucket, both in one task: neither side is shuffled.

    The batch, of ``rows`` rows in all, is held in hash tables; one of more than HASHED_ROWS a bucket is met by sort.
    """
    meet = "shuffle_hash" if rows <= len(parts) * HASHED_ROWS else "merge"
    joined, new = [], []
    for existing, batch in parts:
        existing, batch = in_one_task(existing), in_one_task(batch)
        added = new_only(batch, existing, meet)
        beside = _beside(added if skip_existing else batch).hint(meet)
        # no longer known to be one task, or a union would put all buckets in one
        joined.append(existing.withColumn("_key", _spread_key()).join(beside, "_key", "left").coalesce(2))
        new.append(added.coalesce(2))
    joined, new = (reduce(DataFrame.unionByName, x) for x in (joined, new))
    return _merged(joined, new, F.lit(None) if ingest_ts is None else ingest_ts)


def upsert_fill_missing(
    existing: DataFrame, incoming: DataFrame, ingest_ts: Column | None = None, is_stored: bool = False, has_urls: bool = False,
    late: Callable[[DataFrame], DataFrame] | None = None, dealt: Callable[[DataFrame], DataFrame] | None = None,
    laid: Callable[[DataFrame], DataFrame] | None = None, buckets: int | None = None,
) -> DataFrame:
    """The merged table with a ``change`` column.

    A stored posting with the same url gets its empty fields filled (``enriched``, or
    ``unchanged`` when nothing was missing); an unknown url is ``inserted``; postings the
    batch does not mention have no change. ``incoming`` holds one row per url; it is stored
    first, as it is read several times, unless it is so already.

    The stored side is the left side of one join: when the batch is small enough, Spark
    broadcasts it by measured size and the stored rows are never shuffled. With ``has_urls`` (no stored url is
    null) the join is on the url itself, so that a table bucketed by it is not shuffled for a large batch either.

    Descriptions are nearly all of a table's bytes, so they can be kept out of the shuffles:

    - ``late`` adds ``description`` to stored rows that come without it, after the join; ``laid`` deals out the
      merged rows before that.
    - ``dealt`` deals rows out by a ``bucket`` column of their url and adds it. The stored rows meet a large batch in
      their buckets, in the order they come in, and leave in them.
    - ``buckets`` is how many the stored rows lie in, or are dealt to; a large batch is met there unsorted.

    Unless it is stored, the batch is so in buckets of its url, and is not shuffled again for the joins.
    """
    ingest_ts = F.lit(None) if ingest_ts is None else ingest_ts
    incoming = incoming if is_stored else stored_batch(incoming)
    keys = ["_key"] if dealt is None else ["bucket", "_key"]
    batch = _beside(incoming if dealt is None else dealt(incoming), keys[:-1])
    if buckets is not None and late is None:
        batch = _beside_unsorted(batch, buckets)
    key = F.col("url") if has_urls else _spread_key()
    joined = (existing if dealt is None else dealt(existing)).withColumn("_key", key).join(batch, keys, "left")
    return _merged(joined, new_only(incoming, existing), ingest_ts, late, dealt, laid)


def _beside(batch: DataFrame, held: list[str] | None = None) -> DataFrame:
    """A batch as it is joined to stored rows, by ``_key``."""
    return batch.select(*(held or []), F.col("url").alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in FILLED])


def _spread_key() -> Column:
    """The url; rows stored without one match nothing, their own id spreads them over the tasks."""
    return F.coalesce(F.col("url"), F.concat(F.lit("\0"), F.col("id").cast("string")))


def _merged(
    joined: DataFrame, new: DataFrame, ingest_ts: Column, late: Callable[[DataFrame], DataFrame] | None = None,
    dealt: Callable[[DataFrame], DataFrame] | None = None, laid: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The merged table of stored rows beside those of the batch, and the batch's new rows."""
    filled: dict[str, Column] = {}
    improved = F.lit(False)
    for c in FILLED:
        current, arriving, text = F.col(c), F.col(f"_{c}"), c in TEXT_FIELDS
        if c == "description":
            continue
        improved = improved | (_blank(current, text) & ~_blank(arriving, text))
        if c == "skills":
            filled[c] = F.when(current.isNull(), _stored_skills(arriving)).otherwise(current)
        elif text:
            filled[c] = F.coalesce(non_empty(current), non_empty(arriving), current)
        else:
            filled[c] = F.coalesce(current, arriving)
    slim = [f for f in JOBS_SCHEMA if f.name != "description"]
    held = [c for c in joined.columns if c not in JOBS_SCHEMA.names and not c.startswith("_")]
    change = F.when(F.col("_hit"), F.when(improved, "enriched").otherwise("unchanged"))
    kept = joined.select(
        *[filled.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in slim],
        *(["description"] if late is None else []), *held, "_description", change.alias("change"),
    )
    new = as_new(new, ingest_ts)
    added = new.select(
        *[c for c in new.columns if c != "description"], F.col("description").alias("_description"), F.lit("inserted").alias("change")
    )
    added = added if dealt is None else dealt(added)
    merged = kept.unionByName(added, allowMissingColumns=True)
    merged = merged if laid is None else laid(merged)
    merged = merged if late is None else late(merged)

    current, arriving, change = F.col("description"), F.col("_description"), F.col("change")
    inserted = change.eqNullSafe("inserted")
    enriched = (change == "unchanged") & _blank(current, True) & ~_blank(arriving, True)
    full = {"description": F.when(inserted, arriving).otherwise(F.coalesce(non_empty(current), non_empty(arriving), current)).cast("string")}
    return merged.select(
        *[full.get(f.name, F.col(f.name)).alias(f.name) for f in JOBS_SCHEMA],
        F.when(enriched, "enriched").otherwise(change).alias("change"),
    )


def only_blankness(df: DataFrame) -> DataFrame:
    """Rows with no more of their texts and skills than tells whether they are blank, which is all that a change depends on."""
    texts = {c: F.left(F.col(c), F.lit(1)) for c in TEXT_FIELDS if c in df.columns}
    listed = {"skills": F.when(F.col("skills").isNotNull(), F.array().cast("array<string>"))} if "skills" in df.columns else {}
    return df.withColumns(texts | listed)


def upsert_counts(merged: DataFrame) -> DataFrame:
    """How many incoming rows were inserted, enriched, unchanged and saved."""
    inserted, enriched, unchanged = (
        F.count_if(F.col("change") == c) for c in ("inserted", "enriched", "unchanged")
    )
    return merged.agg(
        inserted.alias("inserted"),
        enriched.alias("enriched"),
        unchanged.alias("unchanged"),
        (inserted + enriched).alias("saved"),
    )


# what a detail page says of a posting
_DETAIL_TEXTS, _DETAIL_SALARIES = ["company", "contract_type", "city", "currency"], ["salary_min", "salary_max"]
_ONLY_DETAIL = ["location_text", "work_mode", "description", "skills"]
DETAIL_FIELDS = [*_DETAIL_TEXTS, *_DETAIL_SALARIES, *_ONLY_DETAIL, "published_at"]


def latest_fetch(details: DataFrame) -> DataFrame:
    """Of several fetches of one url the last."""
    latest = W.partitionBy("url").orderBy(F.col("page_id").desc())
    return details.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth")


def enrich_from_detail(cards: DataFrame, details: DataFrame, ingest_ts: Column) -> DataFrame:
    """Card fields overridden by non-empty detail fields of the same url.

    A detail salary of 0 counts as empty. The publication date is the detail's, even when
    unknown; ``ingest_ts`` stands in only where no detail was fetched. Of several fetches of
    one detail page the last counts.
    """
    detail = latest_fetch(details).select(
        "url", F.lit(True).alias("_fetched"), *[F.col(c).alias(f"_{c}") for c in DETAIL_FIELDS]
    )
    return enriched(cards.join(detail, "url", "left"), cards.columns, ingest_ts)


def enriched(joined: DataFrame, card_columns: list[str], ingest_ts: Column) -> DataFrame:
    """Cards with their detail's fields beside them (``_fetched`` and ``_`` before the field's name) as one posting each."""
    return joined.select(
        *[c for c in card_columns if c not in DETAIL_FIELDS],
        *[F.coalesce(non_empty(F.col(f"_{c}")), F.col(c)).alias(c) for c in _DETAIL_TEXTS],
        *[F.coalesce(F.nullif(F.col(f"_{c}"), F.lit(0)), F.col(c)).alias(c) for c in _DETAIL_SALARIES],
        *[F.col(f"_{c}").alias(c) for c in _ONLY_DETAIL],
        F.when(F.col("_fetched"), F.col("_published_at")).otherwise(ingest_ts).alias("published_at"),
    )
