"""Trend line, forecast and hold-out grades on small series."""

from pyspark.sql import functions as F

from vacantis.operators import series
from vacantis.plans import forecast


def months_of(values, start=1, skill="S", category="technical"):
    return [(category, skill, f"2024-{start + i:02d}", v) for i, v in enumerate(values)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "category string, skill string, month string, count long")


def points(spark, values, horizon):
    df = series.forecast_points(frame(spark, months_of(values)), horizon)
    return [(r["month"], r["count"]) for r in df.orderBy("month").collect()]


def test_linear_forecast(spark):
    assert [c for _, c in points(spark, [7], 3)] == [7, 7, 7]
    assert points(spark, [1, 2, 3], 2) == [("2024-04", 4), ("2024-05", 5)]
    assert [c for _, c in points(spark, [5, 3, 1], 2)] == [0, 0]


def test_no_points_give_zero(spark):
    zero = F.lit(0)
    value = spark.range(1).select(series.fit_value(zero, zero, zero, zero, zero, F.lit(3))).first()[0]
    assert value == 0.0


def test_large_counts_stay_exact(spark):
    heavy = 10**12
    assert [c for _, c in points(spark, [heavy] * 12, 2)] == [heavy, heavy]


def test_next_months_cross_the_year(spark):
    df = series.next_months(frame(spark, [("technical", "S", "2024-11", 1)]), 3)
    assert [r["month"] for r in df.orderBy("step").collect()] == ["2024-12", "2025-01", "2025-02"]


def test_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(series.whole(F.col("v"))).collect()] == [2, 4, 0]


def test_confidence_label(spark):
    df = spark.createDataFrame([(None,), (10.0,), (10.01,), (20.0,), (20.01,)], "v double")
    got = [r[0] for r in df.select(series.confidence_label(F.col("v"))).collect()]
    assert got == ["insufficient-data", "high", "medium", "medium", "low"]


def test_holdout_parts_add_up(spark):
    rows = months_of([1, 2, 3, 4, 5]) + months_of([9], skill="One") + months_of([4, 6], skill="Two")
    split = series.holdout_split(frame(spark, rows), 3)
    got = {(r["skill"], r["is_test"]): r["n"] for r in split.groupBy("skill", "is_test").agg(F.count("*").alias("n")).collect()}
    assert got == {("S", False): 2, ("S", True): 3, ("Two", False): 1, ("Two", True): 1}


def test_reports_agree_with_flat_operators(spark):
    rows = months_of([3, 5, 4, 8]) + months_of([2, 2], skill="T") + months_of([6], skill="U", category="soft")
    df = frame(spark, rows)
    nested = {r["skill"]: r for r in forecast.skill_forecast(df, 10, 3).collect()}
    flat = series.forecast_summary(df, 3).collect()
    assert {r["skill"]: (r["total_observed"], r["projected_total"], r["growth_pct"]) for r in flat} == {
        s: (r["total_observed"], r["projected_total"], r["growth_pct"]) for s, r in nested.items()
    }
    assert {r["skill"] for r in forecast.skill_confidence(df, 10, 2).collect()} == {"S", "T"}
