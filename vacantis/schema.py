"""The posting schema, its evolution and its constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantis.session import stored

JOBS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("location_text", T.StringType()),
    T.StructField("contract_type", T.StringType()),
    T.StructField("work_mode", T.StringType()),
    T.StructField("english_required", T.BooleanType()),
    T.StructField("salary_min", T.IntegerType()),
    T.StructField("salary_max", T.IntegerType()),
    T.StructField("currency", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("seniority", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("url", T.StringType()),
    T.StructField("published_at", T.TimestampNTZType()),
    T.StructField("scraped_at", T.TimestampNTZType()),
])
JOB_COLUMNS = JOBS_SCHEMA.fieldNames()

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

ADDED_COLUMNS = {"location_text": "string", "work_mode": "string", "english_required": "boolean"}


def conform_schema(df: DataFrame) -> DataFrame:
    """Bring an older table up to date: legacy contract column renamed, new columns added."""
    if "remote_type" in df.columns and "contract_type" not in df.columns:
        df = df.withColumnRenamed("remote_type", "contract_type")
    missing = {c: t for c, t in ADDED_COLUMNS.items() if c not in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()})


def project_read_shape(df: DataFrame) -> DataFrame:
    """The columns a posting is read with, in their declared order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in JOBS_SCHEMA])


def flag_invalid(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add ``violation``: NULL, ``missing_source``, ``missing_title`` or ``duplicate_url``.

    Of several rows with one url that have source and title the first by ``order`` stays
    valid, as under a unique index: a refused row takes no url. The rows are numbered and stored once, so equal
    rows are told apart and one of them takes the url. First rows are found by a
    partial aggregate and joined by number, so no url gathers in one task.
    """
    numbered = stored(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    position = F.struct(*[F.col(c) for c in (order or ["id"])], "_row")
    complete = F.col("source").isNotNull() & F.col("title").isNotNull()
    firsts = (
        numbered.where(complete & F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.min(position)["_row"].alias("_row"))
        .select("_row", F.lit(True).alias("_first"))
    )
    return numbered.join(firsts, "_row", "left").withColumn(
        "violation",
        F.when(F.col("source").isNull(), "missing_source")
        .when(F.col("title").isNull(), "missing_title")
        .when(F.col("url").isNotNull() & F.col("_first").isNull(), "duplicate_url"),
    ).drop("_row", "_first")


def split_invalid(df: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy the table constraints, quarantined rows with their violation)."""
    flagged = flag_invalid(df, order)
    return (
        flagged.where(F.col("violation").isNull()).drop("violation"),
        flagged.where(F.col("violation").isNotNull()),
    )
