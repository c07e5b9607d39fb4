"""Date dimension source: one row per day in [start, end]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import date_key


def date_dim(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Calendar rows from Spark's ``range`` (split across tasks), never a driver list."""
    days = spark.range(0, _span(start, end)).select(
        F.date_add(F.to_date(F.lit(start)), F.col("id").cast("int")).alias("full_date"))
    return days.select(
        date_key(F.col("full_date")).alias("date_key"),
        F.col("full_date"),
        F.year("full_date").alias("year"),
        F.quarter("full_date").alias("quarter"),
        F.month("full_date").alias("month"),
        F.date_format("full_date", "MMMM").alias("month_name"),
        F.dayofmonth("full_date").alias("day_of_month"),
        (F.weekday("full_date") + 1).alias("day_of_week"),
        F.weekofyear("full_date").alias("week_of_year"),
    )


def input_range(raw: dict[str, DataFrame]) -> tuple[str, str] | None:
    """First and last day of all dates that facts look up; None without any date."""
    columns = [("mql", "first_contact_date"), ("closed_deals", "won_date"), ("orders", "order_purchase_timestamp")]
    ends = None
    for table, column in columns:
        if table in raw:
            days = raw[table].agg(F.min(F.to_date(column)).alias("lo"), F.max(F.to_date(column)).alias("hi"))
            ends = days if ends is None else ends.unionByName(days)
    lo, hi = ends.agg(F.min("lo"), F.max("hi")).first()
    return None if lo is None else (lo.isoformat(), hi.isoformat())


def _span(start: str, end: str) -> int:
    from datetime import date
    return (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
