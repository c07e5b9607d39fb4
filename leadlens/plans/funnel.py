"""Funnel and speed analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import wilson
from ..operators.aggregates import nearest_rank_percentiles
from .warehouse import Warehouse


def leads_with(wh: Warehouse, *dims: str) -> DataFrame:
    """fact_lead joined to small dimensions (broadcast behind a row check)."""
    df = wh["fact_lead"]
    for d in dims:
        key = {"dim_origin": "origin_key", "dim_segment": "segment_key",
               "dim_landing_page": "landing_page_key"}[d]
        df = df.join(wh.dim(d), key)
    return df


def funnel_by_origin(wh: Warehouse, z: float = 1.96) -> DataFrame:
    """MQLs, deals, conversion and Wilson bounds per origin, dense-ranked."""
    agg = (leads_with(wh, "dim_origin").groupBy(F.col("origin_name").alias("lead_origin"))
           .agg(F.count("lead_key").alias("total_mqls"), F.sum("is_won").cast("long").alias("closed_deals")))
    p, lo, hi = wilson("closed_deals", "total_mqls", z=z)
    out = agg.select("lead_origin", "total_mqls", "closed_deals",
                     F.round(p, 4).alias("conversion_rate"),
                     F.round(lo, 4).alias("wilson_ci_lower"),
                     F.round(hi, 4).alias("wilson_ci_upper"))
    # one row per channel: ranking the aggregate, never raw fact rows
    rank = F.dense_rank().over(Window.orderBy(F.desc("conversion_rate"))).cast("int")
    return out.withColumn("conversion_rank", rank).orderBy(F.desc("conversion_rate"))


def funnel_by(wh: Warehouse, keys: list[str], z: float | None = 1.96) -> DataFrame:
    """C2 generic funnel at any grain of origin / landing page / contact date.

    ``keys`` may name lead_origin, landing_page_id, business_segment and any
    dim_date column (year, month, month_name, quarter, ...).  With ``z`` the
    Wilson bounds are added (rounded to 4 places), without it the view-1 form.
    """
    df = wh["fact_lead"]
    if "lead_origin" in keys:
        df = df.join(wh.dim("dim_origin"), "origin_key").withColumnRenamed("origin_name", "lead_origin")
    if "landing_page_id" in keys:
        df = df.join(wh.dim("dim_landing_page"), "landing_page_key")
    if "business_segment" in keys:
        df = df.join(wh.dim("dim_segment"), "segment_key").withColumnRenamed("segment_name", "business_segment")
    date_cols = [k for k in keys if k in wh["dim_date"].columns]
    if date_cols:
        dd = wh.dim("dim_date").select(F.col("date_key").alias("date_key_first_contact"), *date_cols)
        df = df.join(dd, "date_key_first_contact")
    agg = df.groupBy(*keys).agg(F.count("lead_key").alias("total_mqls"),
                                F.sum("is_won").cast("long").alias("closed_deals"))
    if z is None:
        return agg.withColumn("conversion_rate",
                              F.try_divide(F.col("closed_deals").cast("double"), F.col("total_mqls").cast("double")))
    p, lo, hi = wilson("closed_deals", "total_mqls", z=z)
    return agg.select(*keys, "total_mqls", "closed_deals", F.round(p, 4).alias("conversion_rate"),
                      F.round(lo, 4).alias("wilson_ci_lower"), F.round(hi, 4).alias("wilson_ci_upper"))


def funnel_by_page_month(wh: Warehouse, z: float = 1.96) -> DataFrame:
    """Origin x landing page x contact year/month with Wilson bounds."""
    return funnel_by(wh, ["lead_origin", "landing_page_id", "year", "month", "month_name"], z=z)


def funnel_view(wh: Warehouse) -> DataFrame:
    """C8 (view 1): the same grain, unrounded rate, no interval."""
    return funnel_by(wh, ["lead_origin", "landing_page_id", "year", "month", "month_name"], z=None)


def wilson_funnel(wh: Warehouse, confidence: float = 0.95) -> DataFrame:
    """Per-origin funnel with the exact normal quantile and clamped bounds."""
    from ..functions.exprs import z_for
    agg = (leads_with(wh, "dim_origin").groupBy(F.col("origin_name").alias("origin"))
           .agg(F.count(F.lit(1)).alias("mqls"), F.sum("is_won").cast("long").alias("closed_deals")))
    p, lo, hi = wilson("closed_deals", "mqls", z=z_for(confidence), clamp=True)
    return (agg.select("origin", "mqls", "closed_deals", F.round(p, 4).alias("conversion_rate"),
                       F.round(lo, 4).alias("wilson_ci_lower"), F.round(hi, 4).alias("wilson_ci_upper"))
            .orderBy(F.desc("conversion_rate")))


def time_to_close(wh: Warehouse, by: str = "origin", with_max: bool = True) -> DataFrame:
    """Nearest-rank P50/P75/P90 of days to close over won leads."""
    label, dim, key = {"origin": ("lead_origin", "dim_origin", "origin_name"),
                       "segment": ("business_segment", "dim_segment", "segment_name")}[by]
    won = (wh["fact_lead"].filter((F.col("is_won") == 1) & F.col("days_to_close").isNotNull())
           .join(wh.dim(dim), f"{by}_key").withColumnRenamed(key, label))
    pct = nearest_rank_percentiles(won, [label], "days_to_close",
                                   {"median_days_to_close": 50, "p75_days_to_close": 75,
                                    "p90_days_to_close": 90})
    cols = [label, F.col("_total").alias("total_closed"), F.col("_min").alias("min_days"),
            "median_days_to_close", "p75_days_to_close", "p90_days_to_close"]
    if with_max:
        cols.append(F.col("_max").alias("max_days"))
    return pct.select(*cols).orderBy("median_days_to_close")


def _explorer(wh: Warehouse) -> DataFrame:
    return (wh["fact_lead"].join(wh.dim("dim_origin"), "origin_key")
            .join(wh.dim("dim_landing_page"), "landing_page_key")
            .select("lead_key", "mql_id", "origin_name", "landing_page_id", "is_won", "days_to_close"))


def lead_explorer(wh: Warehouse, limit: int = 100) -> DataFrame:
    """The explorer page, ordered by lead key so the page is deterministic (TakeOrdered)."""
    return _explorer(wh).orderBy("lead_key").limit(limit)


def lead_search(wh: Warehouse, text: str) -> DataFrame:
    """Case-insensitive substring match on mql_id or origin."""
    q = text.lower()
    df = _explorer(wh)
    return df.filter(F.lower("mql_id").contains(q) | F.lower("origin_name").contains(q))
