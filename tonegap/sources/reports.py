"""Metric tables as CSV with ``# key,value`` footer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """All rows as text: fold rows, the mean row and the footers."""
    return spark.read.option("header", True).csv(path)


def fold_rows(report: DataFrame, columns: list[str]) -> DataFrame:
    numeric = report.filter(F.col("fold").rlike("^[0-9]+$"))
    return numeric.select(
        F.col("fold").cast("int").alias("fold"), *[F.col(c).try_cast("double").alias(c) for c in columns]
    )


def footer_values(report: DataFrame) -> DataFrame:
    """``(key, value)`` of the footer rows; the value sits in the next column."""
    value = report.columns[1]
    return report.filter(F.col("fold").startswith("#")).select(
        F.trim(F.regexp_replace("fold", "^#", "")).alias("key"), F.col(value).alias("value")
    )


def mean_part(value: Column) -> Column:
    """Left side of a ``mean±std`` cell."""
    return F.try_element_at(F.split(value, "±"), F.lit(1)).try_cast("double")


def report_mean(report: DataFrame, key: str, column: str) -> DataFrame:
    """A footer value, or the mean of the ``mean±std`` row when the footer is missing."""
    footer = footer_values(report).filter(F.col("key") == key).select(
        F.col("value").try_cast("double").alias("value"), F.lit(0).alias("rank")
    )
    spread = report.filter(F.col("fold") == "mean±std").select(
        mean_part(F.col(column)).alias("value"), F.lit(1).alias("rank")
    )
    both = footer.unionByName(spread)
    return both.agg(F.coalesce(F.min_by("value", "rank"), F.lit(0.0)).alias("value"))
