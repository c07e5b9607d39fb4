"""Chart-ready datasets; rendering itself is not built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import funnel, stats
from .warehouse import Warehouse


def funnel_error_bars(wh: Warehouse) -> DataFrame:
    """G1: conversion in % with asymmetric Wilson error bars."""
    f = funnel.wilson_funnel(wh)
    rate = F.col("conversion_rate") * 100
    return f.select("origin", F.round(rate, 2).alias("rate_pct"),
                    F.round(rate - F.col("wilson_ci_lower") * 100, 2).alias("err_low"),
                    F.round(F.col("wilson_ci_upper") * 100 - rate, 2).alias("err_high"))


def km_top_channels(wh: Warehouse, k: int = 6) -> DataFrame:
    """Step series of the first k channels by name, starting at (0, 1.0)."""
    curve = stats.km_curve_rounded(wh)
    first_k = curve.select("origin").distinct().orderBy("origin").limit(k)      # the chart shows k lines
    c = curve.join(first_k, "origin", "left_semi").select("origin", "time", "survival")
    start = first_k.select("origin", F.lit(0).alias("time"), F.lit(1.0).alias("survival"))
    pts = start.withColumn("_o", F.lit(0)).unionByName(c.withColumn("_o", F.lit(1)))
    w = Window.partitionBy("origin").orderBy("_o", "time")                     # <= distinct days per channel
    return pts.select("origin", (F.row_number().over(w) - 1).cast("int").alias("point"), "time", "survival")


def bootstrap_error_bars(wh: Warehouse, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Mean revenue per deal with bootstrap error bars."""
    b = stats.bootstrap_ci(wh, reps=reps, seed=seed)
    return b.select("origin", "mean_revenue_per_deal",
                    F.round(F.col("mean_revenue_per_deal") - F.col("boot_ci_lower"), 2).alias("err_low"),
                    F.round(F.col("boot_ci_upper") - F.col("mean_revenue_per_deal"), 2).alias("err_high"))
