"""Filters, point lookups and paging over the posting table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis import fixed_values as fixed
from vacantis.functions.text import non_empty
from vacantis.operators.ranking import between, ranked


def bounded(name: str, value: int, bounds: tuple[int, int | None]) -> int:
    """Check a parameter against its allowed range."""
    low, high = bounds
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must lie in {low}..{high if high is not None else ''}, got {value}")
    return value


def filter_jobs(
    df: DataFrame,
    source: str | None = None,
    city: str | None = None,
    contract_type: str | None = None,
    work_mode: str | None = None,
) -> DataFrame:
    """All given equality tests; an empty parameter sets no test."""
    wanted = {"source": source, "city": city, "contract_type": contract_type, "work_mode": work_mode}
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def text_search(df: DataFrame, search: str | None) -> DataFrame:
    """Case-insensitive contains on title, company or description; % and _ stay wildcards."""
    if not search:
        return df
    # a backslash before an ordinary character stands for that character
    pattern = "%" + re.sub(r"\\(.)", lambda m: m[0] if m[1] in "\\%_" else m[1], search, flags=re.S) + "%"
    columns = [F.col(c) for c in ("title", "company", "description")]
    hit = columns[0].ilike(pattern)
    for c in columns[1:]:
        hit = hit | c.ilike(pattern)
    return df.where(hit)


def matching(df: DataFrame, search: str | None = None, **filters: str | None) -> DataFrame:
    return text_search(filter_jobs(df, **filters), search)


def get_by_id(df: DataFrame, job_id: int) -> DataFrame:
    return df.where(F.col("id") == job_id).limit(1)


def get_by_url(df: DataFrame, url: str | None) -> DataFrame:
    """Posting of a url; no url finds a posting stored without one."""
    return df.where(F.col("url").eqNullSafe(F.lit(url))).limit(1)


def with_value(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text column is neither NULL nor empty."""
    return df.where(non_empty(F.col(column)).isNotNull())


def count_filtered(df: DataFrame, search: str | None = None, **filters: str | None) -> DataFrame:
    return matching(df, search, **filters).agg(F.count("*").alias("total"))


def _order(at: str = "scraped_at", key: str = "id") -> list[Column]:
    return [F.col(at).desc_nulls_last(), F.col(key).desc()]


def _looked_up(table: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
    """The rows of a page by fetch time and id, out of a table that no search has to be run over again."""
    keys = keys.select(F.col("scraped_at").alias("_at"), F.col("id").alias("_id"))
    on = F.col("scraped_at").eqNullSafe(F.col("_at")) & F.col("id").eqNullSafe(F.col("_id"))
    return table.join(keys, on, "left_semi").orderBy(*_order()).limit(limit)


def newest_first(df: DataFrame, limit: int, offset: int = 0, table: DataFrame | None = None) -> DataFrame:
    """Rows ``offset .. offset+limit`` by fetch time and id, newest first.

    Only fetch times and ids are ordered, in ranges with a count each, so any offset reads the ranges that
    hold the page. The page's rows, ``limit`` of them, are looked up in ``table``, of which ``df`` is a part.
    """
    bounded("limit", limit, (0, None))
    bounded("offset", offset, (0, None))
    found = ranked(df.select("scraped_at", "id"), _order())
    return _looked_up(df if table is None else table, between(found, offset, offset + limit), limit)


def search_jobs(
    df: DataFrame,
    search: str | None = None,
    limit: int = 50,
    offset: int = 0,
    **filters: str | None,
) -> tuple[DataFrame, DataFrame]:
    """(total, page): the count of matching postings and one page of them; the search runs once for both."""
    bounded("limit", limit, fixed.SEARCH_LIMIT)
    bounded("offset", offset, (0, None))
    found = ranked(matching(df, search, **filters).select("scraped_at", "id"), _order())
    total = df.sparkSession.range(1).select(
        F.lit(found.total).cast("long").alias("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset")
    )
    return total, _looked_up(df, between(found, offset, offset + limit), limit)


def list_recent(df: DataFrame, limit: int = fixed.RECENT_LIMIT) -> DataFrame:
    return newest_first(df, limit)
