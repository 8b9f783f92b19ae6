"""Counts and distributions over the posting table.

Every count is a partial aggregate before its shuffle, so a value that holds a large
share of the rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantis import fixed_values as fixed
from vacantis.functions.skills import (
    category_of, denormalize_skill, format_skill, normalize_skill, normalize_skills,
)
from vacantis.functions.text import detect_english, detect_work_mode, month_key, non_empty


def total_jobs(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_jobs"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Postings per non-empty value of a text column."""
    value = non_empty(F.col(column)).alias("value")
    return df.select(value).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("jobs"))


def effective_work_mode() -> Column:
    """Stored work mode, else the detected one."""
    located = F.coalesce(non_empty(F.col("location_text")), F.col("city"))
    return F.coalesce(non_empty(F.col("work_mode")), detect_work_mode(located, F.col("contract_type")))


def has_work_mode_input() -> Column:
    fields = ("work_mode", "location_text", "city", "contract_type")
    return F.coalesce(*[non_empty(F.col(c)) for c in fields]).isNotNull()


def work_mode_counts(df: DataFrame) -> DataFrame:
    """Postings per work mode; rows with some input but no detected mode count under NULL."""
    return (
        df.where(has_work_mode_input())
        .groupBy(effective_work_mode().alias("work_mode"))
        .agg(F.count("*").alias("jobs"))
    )


def skill_counts(df: DataFrame) -> DataFrame:
    """Occurrences per category and displayed skill.

    Raw spellings are counted first: the spelling rules then run once per distinct
    spelling instead of once per occurrence.
    """
    raw = df.select(F.explode("skills").alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    # an explode drops blank spellings; a filter would be pushed below the count
    spelled = raw.select("n", F.explode(normalize_skills(F.array("raw"))).alias("skill"))
    return categorised(spelled).groupBy("category", "skill").agg(F.sum("n").alias("occurrences"))


def categorised(df: DataFrame) -> DataFrame:
    """Category and display form of a normalised ``skill`` column (normalised once more)."""
    again = F.col("_again")
    return (
        df.withColumn("_again", normalize_skill(F.col("skill")))
        .withColumns({"category": category_of(again), "skill": denormalize_skill(again)})
        .drop("_again")
    )


def salary_summary(df: DataFrame) -> DataFrame:
    """Mean and count of stated salaries; zero counts, NULL does not."""
    return df.agg(
        F.bround(F.avg("salary_min"), 2).alias("avg_salary_min"),
        F.bround(F.avg("salary_max"), 2).alias("avg_salary_max"),
        F.count("salary_min").alias("with_salary_min_count"),
        F.count("salary_max").alias("with_salary_max_count"),
    )


def posting_month() -> Column:
    return month_key(F.col("published_at"), F.col("scraped_at"))


def monthly_trend(df: DataFrame) -> DataFrame:
    """Postings per month of publication, else of fetch."""
    return (
        df.select(posting_month().alias("month"))
        .where("month IS NOT NULL")
        .groupBy("month")
        .agg(F.count("*").alias("jobs"))
        .orderBy("month")
    )


def effective_english() -> Column:
    """Stored requirement, else the one detected in the texts."""
    texts = [F.col(c) for c in ("title", "description", "location_text")]
    return F.coalesce(F.col("english_required"), detect_english(*texts))


def english_label(required: Column) -> Column:
    return F.when(required, "required").when(~required, "not_required").otherwise("unknown")


def english_distribution(df: DataFrame) -> DataFrame:
    return (
        df.select(effective_english().alias("required"))
        .groupBy("required")
        .agg(F.count("*").alias("jobs"))
        .select(english_label(F.col("required")).alias("requirement"), "jobs")
    )


def percentage(part: Column, whole: Column) -> Column:
    return F.bround(part / whole * 100.0, 2)


def english_monthly_trend(df: DataFrame) -> DataFrame:
    """Per month: postings asking for English, all postings, share in percent."""
    return (
        df.select(posting_month().alias("month"), effective_english().alias("english"))
        .where("month IS NOT NULL")
        .groupBy("month")
        .agg(F.count_if("english").alias("required"), F.count("*").alias("total"))
        .withColumn("pct_required", percentage(F.col("required"), F.col("total")))
        .orderBy("month")
    )


def ingest_stats(df: DataFrame) -> DataFrame:
    """Total, and postings per source, city and company, in one pass over the table.

    A NULL or empty source is counted; empty cities and companies are not.
    """
    pairs = F.array(
        F.struct(F.lit("total").alias("metric"), F.lit(None).cast("string").alias("value")),
        F.struct(F.lit("sources").alias("metric"), F.col("source").alias("value")),
        F.struct(F.lit("cities").alias("metric"), non_empty(F.col("city")).alias("value")),
        F.struct(F.lit("companies").alias("metric"), non_empty(F.col("company")).alias("value")),
    )
    return (
        df.select(F.inline(pairs))
        .where("value IS NOT NULL OR metric IN ('total', 'sources')")
        .groupBy("metric", "value")
        .agg(F.count("*").alias("jobs"))
    )


def skill_month_counts(df: DataFrame) -> DataFrame:
    """Postings per category, displayed skill and month; a skill counts once per posting.

    Counting by stored spelling first keeps the display rules off the posting rows.
    """
    per_spelling = _spelling_months(df)
    return categorised(per_spelling).groupBy("category", "skill", "month").agg(F.sum("n").alias("count"))


def skill_month_counts_all(df: DataFrame) -> DataFrame:
    """The same counts without the split by category."""
    return (
        _spelling_months(df)
        .withColumn("skill", format_skill(F.col("skill")))
        .groupBy("skill", "month")
        .agg(F.sum("n").alias("count"))
    )


def _spelling_months(df: DataFrame) -> DataFrame:
    """Postings per stored spelling and month; a stored spelling is never blank."""
    return (
        df.select(posting_month().alias("month"), "skills")
        .where("month IS NOT NULL")
        .select("month", F.explode(normalize_skills(F.col("skills"))).alias("skill"))
        .groupBy("skill", "month")
        .agg(F.count("*").alias("n"))
    )


def top_k(df: DataFrame, k: int, count: str, key: str, per: str | None = None) -> DataFrame:
    """The k largest counts, ties by key; with ``per``, k in each group.

    Spark cuts each task to k rows per group before the shuffle (window group limit).
    """
    order = [F.col(count).desc(), F.col(key).asc_nulls_last()]
    if per is None:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(W.partitionBy(per).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def top_cities(df: DataFrame, k: int = fixed.TOP_CITIES) -> DataFrame:
    return top_k(value_counts(df, "city"), k, "jobs", "value")
