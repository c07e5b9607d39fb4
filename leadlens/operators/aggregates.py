"""Aggregation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank_percentiles(df: DataFrame, by: list[str], value: str,
                             pcts: dict[str, int]) -> DataFrame:
    """The reference's nearest-rank percentile, without windowing raw rows.

    For each group with n non-null values sorted ascending, percentile p is
    the value at 1-based position ``round(p/100 * n)`` (half up); position 0
    gives NULL, as in the reference's ``row_num = ROUND(q*n)`` test.
    Rows are first reduced to a (group, value) histogram, so a hot group costs
    one row per distinct value; the running count runs over that histogram.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    hist = (hist.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("_n", F.sum("_c").over(Window.partitionBy(*by))))
    aggs = [F.sum("_c").alias("_total"), F.min(value).alias("_min"), F.max(value).alias("_max")]
    for name, p in pcts.items():
        rank = F.floor((F.col("_n") * (2 * p) + 100) / 200)   # round(p/100*n), half up, exact
        hit = (rank >= 1) & (F.col("_cum") - F.col("_c") < rank) & (F.col("_cum") >= rank)
        aggs.append(F.max(F.when(hit, F.col(value))).alias(name))
    return hist.groupBy(*by).agg(*aggs)


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """NULL count per column in one pass, long form (table, column, value)."""
    exprs = [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(c) for c in df.columns]
    wide = df.agg(*exprs)
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr(f"'{table}' AS table_name", f"stack({len(df.columns)}, {stack}) AS (column_name, value)")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first per key (pandas ``duplicated().sum()``; NULLs equal)."""
    return (df.groupBy(*keys).count()
              .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates")))
