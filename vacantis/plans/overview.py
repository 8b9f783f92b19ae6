"""The overview report: every distribution of the posting table in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantis import fixed_values as fixed
from vacantis.functions.skills import normalize_skills
from vacantis.functions.text import non_empty
from vacantis.operators import counts
from vacantis.operators.search import bounded
from vacantis.sources.tables import scan_for_analytics

TOP_METRICS = [
    "top_sources", "top_cities", "contract_type_distribution", "work_mode_distribution",
    "seniority_distribution", "technical_skills", "soft_skills",
]


def _entry(metric: str, key: Column, flag: Column | None = None) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"),
        key.cast("string").alias("key"),
        (F.lit(False) if flag is None else flag).alias("flag"),
    )


def overview(
    df: DataFrame, source: str | None = None, city: str | None = None, top_n: int = 10
) -> DataFrame:
    """Long form ``(metric, key, value)`` of all overview figures.

    One scan feeds one aggregation: each posting is turned into (metric, key) entries,
    which collapse before the shuffle. A second small aggregation joins skill spellings.
    """
    top_n = max(bounded("top_n", top_n, fixed.TOP_N), fixed.TOP_N_FLOOR)
    jobs = scan_for_analytics(df, source, city)
    none = F.lit(None).cast("string")

    derived = jobs.select(
        "source", "city", "contract_type", "seniority", "skills",
        F.when(counts.has_work_mode_input(), F.struct(counts.effective_work_mode().alias("mode"))).alias("mode"),
        counts.effective_english().alias("english"),
        counts.posting_month().alias("month"),
        "salary_min", "salary_max",
    )
    required = F.coalesce(F.col("english"), F.lit(False))
    entries = F.concat(
        F.array(
            F.when(non_empty(F.col("source")).isNotNull(), _entry("top_sources", F.col("source"))),
            F.when(non_empty(F.col("city")).isNotNull(), _entry("top_cities", F.col("city"))),
            F.when(
                non_empty(F.col("contract_type")).isNotNull(),
                _entry("contract_type_distribution", F.col("contract_type")),
            ),
            F.when(F.col("mode").isNotNull(), _entry("work_mode_distribution", F.col("mode.mode"))),
            F.when(
                non_empty(F.col("seniority")).isNotNull(),
                _entry("seniority_distribution", F.col("seniority")),
            ),
            _entry("english_requirement_distribution", counts.english_label(F.col("english"))),
            F.when(F.col("month").isNotNull(), _entry("monthly", F.col("month"), required)),
            _entry("total", none),
        ),
        F.transform(
            F.coalesce(F.col("skills"), F.array().cast("array<string>")),
            lambda s: _entry("raw_skill", s),
        ),
    )
    # salaries ride on the single "total" entry of each posting
    is_total = F.col("e.metric") == "total"
    counted = (
        derived.select(F.explode(F.array_compact(entries)).alias("e"), "salary_min", "salary_max")
        .groupBy("e.metric", "e.key")
        .agg(
            F.count("*").alias("n"),
            F.count_if("e.flag").alias("flagged"),
            F.sum(F.when(is_total, F.col("salary_min").cast("long"))).alias("sum_min"),
            F.count(F.when(is_total, F.col("salary_min"))).alias("with_min"),
            F.sum(F.when(is_total, F.col("salary_max").cast("long"))).alias("sum_max"),
            F.count(F.when(is_total, F.col("salary_max"))).alias("with_max"),
        )
    )

    # an empty selection still reports zero postings
    measures = ("n", "flagged", "sum_min", "with_min", "sum_max", "with_max")
    nothing = df.sparkSession.range(1).select(
        F.lit("total").alias("metric"), none.alias("key"),
        *[F.lit(None if c.startswith("sum") else 0).cast("long").alias(c) for c in measures],
    )
    counted = counted.unionByName(nothing)

    # raw spellings become displayed skills, everything else keeps its key
    is_skill = F.col("metric") == "raw_skill"
    spellings = F.when(is_skill, normalize_skills(F.array("key"))).otherwise(F.array(none))
    # an explode drops blank spellings; a filter would be pushed below the count
    spelled = counted.select("metric", "key", *measures, F.explode(spellings).alias("skill"))
    named = counts.categorised(spelled).select(
        F.when(is_skill, F.concat("category", F.lit("_skills"))).otherwise(F.col("metric")).alias("metric"),
        F.when(is_skill, F.col("skill")).otherwise(F.col("key")).alias("key"),
        *measures,
    )
    merged = named.groupBy("metric", "key").agg(*[F.sum(c).alias(c) for c in measures])
    ranked = counts.top_k(_ranked_groups(merged), top_n, "n", "key", per="cut_group")
    return ranked.select("metric", "key", F.inline(_figures())).select(
        F.coalesce(F.col("figure_metric"), F.col("metric")).alias("metric"),
        F.coalesce(F.col("figure_key"), F.col("key")).alias("key"),
        "value",
    )


def _ranked_groups(merged: DataFrame) -> DataFrame:
    """Metrics with a top-n cut share a group; the other rows form groups of their own."""
    cut = F.col("metric").isin(TOP_METRICS)
    group = F.when(cut, F.col("metric")).otherwise(F.concat_ws("\0", "metric", "key"))
    return merged.withColumn("cut_group", group)


def _figures() -> Column:
    """Output rows of one counted entry."""
    none = F.lit(None).cast("string")

    def figure(value: Column, metric: Column = none, key: Column = none) -> Column:
        return F.struct(
            metric.alias("figure_metric"), key.alias("figure_key"), value.cast("double").alias("value")
        )

    n, flagged = F.col("n"), F.col("flagged")
    english_month = F.lit("english_requirement_monthly_trend")
    salary = F.lit("salary")
    return (
        F.when(
            F.col("metric") == "total",
            F.array(
                figure(n, F.lit("total_jobs"), F.lit("")),
                figure(F.bround(F.try_divide("sum_min", "with_min"), 2), salary, F.lit("avg_salary_min")),
                figure(F.bround(F.try_divide("sum_max", "with_max"), 2), salary, F.lit("avg_salary_max")),
                figure(F.col("with_min"), salary, F.lit("with_salary_min_count")),
                figure(F.col("with_max"), salary, F.lit("with_salary_max_count")),
            ),
        )
        .when(
            F.col("metric") == "monthly",
            F.array(
                figure(n, F.lit("monthly_trend")),
                figure(flagged, english_month, F.concat("key", F.lit(" required"))),
                figure(n, english_month, F.concat("key", F.lit(" total"))),
                figure(
                    counts.percentage(flagged, n), english_month, F.concat("key", F.lit(" pct_required"))
                ),
            ),
        )
        .when(
            F.col("metric") == "technical_skills",
            F.array(figure(n), figure(n, F.lit("top_skills"))),
        )
        .otherwise(F.array(figure(n)))
    )
