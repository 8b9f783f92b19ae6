"""Monthly skill series: trend line, forecast, hold-out error.

Input of the flat operators is ``(category, skill, month, count)``. A series has one
row per calendar month at most, so a group stays small however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES = ["category", "skill"]


def ordinal_index(series: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Position 0..n-1 of each observed month in its series; missing months are skipped."""
    order = W.partitionBy(*keys).orderBy("month")
    return series.withColumn("x", F.row_number().over(order) - 1)


def _exact(c: Column) -> Column:
    """Whole numbers wide enough for the products of a long, heavy series."""
    return c.cast("decimal(38,0)")


def fit_value(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column, x: Column) -> Column:
    """Least-squares line at x from whole-number sums, floored at 0; one division only.

    A single point gives a constant line, no point gives zero.
    """
    n, sx, sy, sxy, sxx, x = map(_exact, (n, sx, sy, sxy, sxx, x))
    spread = _exact(n * sxx - sx * sx)
    slope = _exact(n * sxy - sx * sy)
    numerator = _exact(_exact(sy * spread) + _exact(slope * _exact(n * x - sx)))
    line = numerator.cast("double") / F.nullif(_exact(n * spread), F.lit(0)).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.greatest(F.coalesce(line, sy.cast("double")), F.lit(0.0))
    )


def whole(c: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.bround(F.greatest(c, F.lit(0.0)), 0).cast("long")


def fit_sums(points: DataFrame) -> DataFrame:
    """The five sums of each series of ``(x, count)`` points."""
    x, y = F.col("x").cast("long"), F.col("count")
    return points.groupBy(*SERIES).agg(
        F.count("*").alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"),
        F.sum(x * x).alias("sxx"),
        F.max("month").alias("last_month"),
    )


def fit_at(x: Column) -> Column:
    return fit_value(*[F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx")], x)


def linear_fit(points: DataFrame) -> DataFrame:
    """Trend line of each series: its value at the first and the next ordinal."""
    return fit_sums(points).select(
        *SERIES, "n", fit_at(F.lit(0)).alias("at_start"), fit_at(F.col("n")).alias("at_next")
    )


def month_after(month: Column, steps: Column) -> Column:
    """The calendar month ``steps`` after a ``yyyy-MM`` month."""
    first_day = F.to_date(F.concat(month, F.lit("-01")))
    return F.date_format(F.add_months(first_day, steps), "yyyy-MM")


def next_months(series: DataFrame, months_ahead: int) -> DataFrame:
    """Calendar months that follow each series."""
    last = series.groupBy(*SERIES).agg(F.max("month").alias("last_month"))
    return last.select(
        *SERIES, "last_month", F.explode(F.sequence(F.lit(1), F.lit(months_ahead))).alias("step")
    ).withColumn("month", month_after(F.col("last_month"), F.col("step")))


def forecast_points(series: DataFrame, months_ahead: int) -> DataFrame:
    """Forecast counts of each series for the months after its last one."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(months_ahead))).alias("step")
    return (
        fit_sums(ordinal_index(series))
        .select("*", steps)
        .select(
            *SERIES,
            month_after(F.col("last_month"), F.col("step")).alias("month"),
            whole(fit_at(F.col("n") + F.col("step") - 1)).alias("count"),
        )
    )


def growth(last_forecast: Column, last_observed: Column) -> Column:
    """Change of the last forecast against the last observed count, in percent."""
    change = (last_forecast - last_observed) / last_observed * 100.0
    return F.when(last_observed > 0, F.bround(change, 2))


def forecast_summary(series: DataFrame, months_ahead: int) -> DataFrame:
    """Observed total, projected total and growth of each series."""
    observed = series.groupBy(*SERIES).agg(
        F.sum("count").alias("total_observed"), F.max_by("count", "month").alias("last_observed")
    )
    projected = forecast_points(series, months_ahead).groupBy(*SERIES).agg(
        F.sum("count").alias("projected_total"), F.max_by("count", "month").alias("last_forecast")
    )
    return observed.join(projected, SERIES).select(
        *SERIES, "total_observed", "projected_total",
        growth(F.col("last_forecast"), F.col("last_observed")).alias("growth_pct"),
    )


def holdout_split(series: DataFrame, test_months: int, keys: list[str] = SERIES) -> DataFrame:
    """Mark the last min(h, n-1) points of each series as test; drop one-point series."""
    points = F.count("*").over(W.partitionBy(*keys))
    held = F.least(F.lit(test_months), F.col("n") - 1)
    return (
        ordinal_index(series, keys)
        .withColumn("n", points)
        .where("n > 1")
        .withColumn("is_test", F.col("x") >= F.col("n") - held)
    )


def forecast_error(split: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Mean absolute and mean percentage error of the trend line on the test points.

    The train sums are window sums over the same partitioning the split already has.
    """
    train, series = ~F.col("is_test"), W.partitionBy(*keys)
    x, y = F.col("x").cast("long"), F.col("count")

    def train_sum(value: Column) -> Column:
        return F.sum(F.when(train, value)).over(series)

    fitted = split.withColumns({
        "train_points": F.count_if(train).over(series),
        "sx": train_sum(x),
        "sy": train_sum(y),
        "sxy": train_sum(x * y),
        "sxx": train_sum(x * x),
    }).where("is_test")
    sums = [F.col(c) for c in ("train_points", "sx", "sy", "sxy", "sxx")]
    error = F.abs(F.col("count") - F.col("predicted"))
    share = F.when(F.col("count") > 0, error / F.col("count") * 100.0)
    return (
        fitted.withColumn("predicted", whole(fit_value(*sums, F.col("x"))))
        .groupBy(*keys)
        .agg(
            F.max("train_points").alias("train_points"),
            F.count("*").alias("test_points"),
            F.bround(F.sum(error) / F.count("*"), 2).alias("mae"),
            F.bround(F.avg(share), 2).alias("mape_pct"),
        )
    )


def confidence_label(mape: Column) -> Column:
    """Grade of an already rounded percentage error."""
    return (
        F.when(mape.isNull(), "insufficient-data")
        .when(mape <= 10, "high")
        .when(mape <= 20, "medium")
        .otherwise("low")
    )
