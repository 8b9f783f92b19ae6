"""Skill demand forecast and its hold-out confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis import fixed_values as fixed
from vacantis.operators import counts, series
from vacantis.operators.search import bounded
from vacantis.sources.tables import scan_for_analytics


def top_series(skill_months: DataFrame, top_n: int) -> DataFrame:
    """One row for each of the top-n skills of a category, with its months in order.

    Totals and months come from one aggregation, so the table is read once; a series is
    bounded by the calendar. The cut to n rows per category happens before the shuffle.
    """
    whole_series = skill_months.groupBy(*series.SERIES).agg(
        F.sum("count").alias("total"),
        F.array_sort(F.collect_list(F.struct("month", "count"))).alias("history"),
    )
    return counts.top_k(whole_series, top_n, "total", "skill", per="category")


def _line(counts_: Column, n: Column, x: Column) -> Column:
    """Trend line over the first ``n`` values of an ordered series, at ``x``."""
    values = F.slice(counts_, F.lit(1), n)
    zero = F.lit(0).cast("long")
    sy = F.aggregate(values, zero, lambda total, v: total + v)
    sxy = F.aggregate(F.transform(values, lambda v, i: v * i), zero, lambda total, v: total + v)
    n = n.cast("long")
    sx = F.floor(n * (n - 1) / 2)
    sxx = F.floor(n * (n - 1) * (2 * n - 1) / 6)
    return series.fit_value(n, sx, sy, sxy, sxx, x)


def _checked_top(top_n: int) -> int:
    return max(bounded("top_n", top_n, fixed.TOP_N), fixed.TOP_N_FLOOR)


def skill_forecast(skill_months: DataFrame, top_n: int = 10, months_ahead: int = 3) -> DataFrame:
    """History, forecast, totals and growth of the top skills of each category."""
    top_n = _checked_top(top_n)
    bounded("months_ahead", months_ahead, fixed.MONTHS_AHEAD)
    history = F.col("history")
    n, last = F.size(history), F.element_at(history, -1)

    def point(step: Column) -> Column:
        value = _line(history["count"], n, n + step - 1)
        return F.struct(
            series.month_after(last["month"], step).alias("month"), series.whole(value).alias("count")
        )

    return (
        top_series(skill_months, top_n)
        .withColumn("forecast", F.transform(F.sequence(F.lit(1), F.lit(months_ahead)), point))
        .select(
            "category", "rank", "skill", "history", "forecast",
            F.col("total").alias("total_observed"),
            F.aggregate(
                F.col("forecast.count"), F.lit(0).cast("long"), lambda total, v: total + v
            ).alias("projected_total"),
            series.growth(F.element_at("forecast", -1)["count"], last["count"]).alias("growth_pct"),
        )
    )


def skill_confidence(skill_months: DataFrame, top_n: int = 10, test_months: int = 2) -> DataFrame:
    """Hold-out errors and grade of the top skills; one-month skills drop out after the cut."""
    bounded("test_months", test_months, fixed.TEST_MONTHS)
    top = top_series(skill_months, _checked_top(top_n))
    points = top.select("category", "rank", "skill", F.inline("history"))
    keys = ["category", "rank", "skill"]
    errors = series.forecast_error(series.holdout_split(points, test_months, keys), keys)
    return errors.withColumn("confidence_level", series.confidence_label(F.col("mape_pct")))


def demand_forecast(
    df: DataFrame,
    source: str | None = None,
    city: str | None = None,
    top_n: int = 10,
    months_ahead: int = 3,
) -> DataFrame:
    """Forecast of both categories with the number of postings analysed."""
    jobs = scan_for_analytics(df, source, city)
    return _with_total(skill_forecast(counts.skill_month_counts(jobs), top_n, months_ahead), jobs)


def forecast_confidence(
    df: DataFrame,
    source: str | None = None,
    city: str | None = None,
    top_n: int = 10,
    test_months: int = 2,
) -> DataFrame:
    """Confidence of both categories with the number of postings analysed."""
    jobs = scan_for_analytics(df, source, city)
    return _with_total(skill_confidence(counts.skill_month_counts(jobs), top_n, test_months), jobs)


def _with_total(report: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add the posting count as a scalar subquery; it reads no column of the table."""
    total = jobs.agg(F.count("*")).scalar()
    return report.withColumn("total_jobs_analyzed", total)
