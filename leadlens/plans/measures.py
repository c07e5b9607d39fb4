"""BI measures evaluated at a chosen grain.

Grains: ``origin`` (one row per channel), ``overall`` (one row) and
``month`` (every calendar year/month: first contact for lead measures, purchase
for item measures, a seller's first order for the days to it).  The lead-side and item-side aggregates are stacked with
``unionByName`` and folded by one ``groupBy`` on the grain, so no join is
needed even for the one-row grain.  Item measures at channel grain use the
channel's signed sellers as a filter (each item counted once per channel).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio_or, wilson
from ..operators.bitmaps import distinct_counts
from ..operators.joins import broadcast_if
from .channel import performance_tag
from .revenue import bridge, seller_post_signing
from .warehouse import Warehouse

LEAD_COLS = ["mqls", "closed_deals", "median_days_to_close", "p75_days_to_close"]
FIRST = 1 << 32   # above every date key
ITEM_COLS = ["rev", "gmv", "freight", "active_sellers", "orders", "review_sum", "review_n", "r90", "r180"]


def _grain_cols(grain: str, date_key: str) -> list[Column]:
    if grain == "origin":
        return [F.col("origin_name").alias("lead_origin")]
    if grain == "month":
        return [F.floor(F.col(date_key) / 10000).cast("int").alias("year"),
                (F.floor(F.col(date_key) / 100) % 100).cast("int").alias("month")]
    return []


def _keys(grain: str) -> list[str]:
    return {"origin": ["lead_origin"], "month": ["year", "month"], "overall": []}[grain]


def _lead_side(wh: Warehouse, grain: str) -> DataFrame:
    f = wh["fact_lead"]
    if grain == "origin":
        f = f.join(wh.dim("dim_origin"), "origin_key")
    won_days = F.when((F.col("is_won") == 1) & F.col("days_to_close").isNotNull(), F.col("days_to_close"))
    return f.groupBy(*_grain_cols(grain, "date_key_first_contact")).agg(
        F.count(F.lit(1)).alias("mqls"),                                     # M1
        F.sum("is_won").cast("long").alias("closed_deals"),                  # M2
        F.percentile(won_days, F.lit(0.5)).alias("median_days_to_close"),    # M8 (MEDIANX, interpolated)
        F.percentile(won_days, F.lit(0.75)).alias("p75_days_to_close"))      # M9 (PERCENTILEX.INC)


def _item_side(wh: Warehouse, grain: str, post_signing_only: bool, windows: tuple[int, int]) -> DataFrame:
    per = _seller_orders(wh, post_signing_only, windows)
    if grain == "origin":
        per = per.join(broadcast_if(bridge(wh, "lead_origin").select("seller_key", "lead_origin"), wh.rows.get("seller_lead")), "seller_key")
    return distinct_counts(per, _keys(grain), {
        "active_sellers": F.when(F.col("_live") == 1, F.col("seller_key")),                  # M14
        "orders": F.col("order_key")},
        {c: F.col(c) for c in ("rev", "gmv", "freight", "review_sum", "review_n", "r90", "r180")})


def _seller_orders(wh: Warehouse, post_signing_only: bool, windows: tuple[int, int]) -> DataFrame:
    """One row per (seller, order), with its purchase month: what the measures of every grain add up.
    The fact's buckets hold an order whole, so this is one scan without a shuffle, written once
    per warehouse."""
    def build() -> DataFrame:
        items = wh["fact_order_item"]
        if post_signing_only:                                                # D8 default
            items = items.filter(F.col("days_after_won") >= 0)
        live = (F.col("days_after_won") >= 0) & (F.col("order_status") != "canceled")
        lower = (F.col("days_after_won") >= 0) if post_signing_only else F.lit(True)
        return items.groupBy("seller_key", "order_id", "order_key", *_grain_cols("month", "date_key_purchase")).agg(
            F.sum("price").alias("rev"), F.sum(F.col("price") + F.col("freight_value")).alias("gmv"),
            F.sum("freight_value").alias("freight"),
            F.sum("review_score").alias("review_sum"), F.count("review_score").alias("review_n"),
            F.sum(F.when(lower & (F.col("days_after_won") <= windows[0]), F.col("price"))).alias("r90"),
            F.sum(F.when(lower & (F.col("days_after_won") <= windows[1]), F.col("price"))).alias("r180"),
            F.max(F.when(live, 1)).alias("_live"),
            # (days, date key) as one number, which a hash aggregate can keep
            F.min(F.when(F.col("days_after_won") >= 0, F.col("days_after_won") * F.lit(FIRST) + F.col("date_key_purchase"))).alias("first"))

    name = f"seller_orders_{'post' if post_signing_only else 'all'}_{windows[0]}_{windows[1]}"
    return wh.derived(name, build, aggregated=False)


def _first_orders(wh: Warehouse, grain: str, post_signing_only: bool, windows: tuple[int, int]) -> DataFrame:
    """M10 over view 3 rows; by month, a seller's days belong to the month of that first order."""
    rows = seller_post_signing(wh)
    if grain == "month":
        first = (_seller_orders(wh, post_signing_only, windows).groupBy("seller_key").agg(F.min("first").alias("first"))
                 .select("seller_key", (F.col("first") % FIRST).alias("date_key_purchase")).select("seller_key", *_grain_cols("month", "date_key_purchase")))
        rows = rows.select("seller_key", "days_to_first_order").join(first, "seller_key")
    return rows.groupBy(*_keys(grain)).agg(F.avg("days_to_first_order").alias("avg_days_to_first_order"))


def measures(wh: Warehouse, grain: str = "origin", z: float = 1.96, post_signing_only: bool = True,
             windows: tuple[int, int] = (90, 180), rules: dict[str, float] | None = None) -> DataFrame:
    keys = _keys(grain)
    lead, item = _lead_side(wh, grain), _item_side(wh, grain, post_signing_only, windows)
    stacked = lead.unionByName(item, allowMissingColumns=True).unionByName(
        _first_orders(wh, grain, post_signing_only, windows), allowMissingColumns=True)
    if grain == "month":                                                     # every month of the calendar
        stacked = stacked.unionByName(wh["dim_date"].select("year", "month").distinct(), allowMissingColumns=True)
    m = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in [*LEAD_COLS, *ITEM_COLS, "avg_days_to_first_order"]])
    mqls = F.coalesce("mqls", F.lit(0)).cast("long")
    closed = F.coalesce("closed_deals", F.lit(0)).cast("long")
    rev = F.coalesce(F.col("rev").cast("double"), F.lit(0.0))
    gmv = F.coalesce(F.col("gmv").cast("double"), F.lit(0.0))
    active = F.coalesce("active_sellers", F.lit(0)).cast("long")
    conv = ratio_or(closed, mqls)                                           # M3
    _, lo, hi = wilson(closed, mqls, z=z)                                    # M6, M7
    out = m.select(
        *keys, mqls.alias("mqls"), closed.alias("closed_deals"), conv.alias("conversion_rate"),
        lo.alias("wilson_ci_lower"), hi.alias("wilson_ci_upper"),
        "median_days_to_close", "p75_days_to_close", "avg_days_to_first_order",
        rev.alias("revenue_post_signing"),                                   # M11
        gmv.alias("total_gmv"),                                              # M12
        ratio_or(rev, closed).alias("revenue_per_closed_deal"),             # M13
        active.alias("active_sellers"),                                      # M14
        ratio_or(active, closed).alias("activation_rate"),                  # M15
        ratio_or(rev, active).alias("revenue_per_active_seller"),           # M16
        ratio_or(rev, F.coalesce("orders", F.lit(0))).alias("average_order_value"),   # M17
        F.try_divide(F.col("review_sum").cast("double"), F.col("review_n").cast("double")).alias("avg_review_score"),  # M18
        ratio_or(F.col("freight").cast("double"), gmv).alias("freight_share"),        # M19
        F.coalesce(F.col("r90").cast("double"), F.lit(0.0)).alias(f"revenue_{windows[0]}d"),   # M20
        F.coalesce(F.col("r180").cast("double"), F.lit(0.0)).alias(f"revenue_{windows[1]}d"))  # M21
    if grain == "origin":                                                    # A15, N7: ALL('dim_origin')
        every = Window.partitionBy()                                         # one row per channel
        overall = ratio_or(F.sum("closed_deals").over(every), F.sum("mqls").over(every))
        out = out.withColumn("overall_conversion_rate", overall).withColumn(
            "channel_rank", F.dense_rank().over(Window.orderBy(F.desc("revenue_per_closed_deal"))).cast("int"))
    else:
        out = out.withColumn("overall_conversion_rate", F.col("conversion_rate")).withColumn(
            "channel_rank", F.lit(None).cast("int"))
    out = out.withColumn("conversion_vs_overall", F.col("conversion_rate") - F.col("overall_conversion_rate"))  # M5
    out = out.withColumn("performance_tag", performance_tag(                # M23
        F.col("conversion_rate"), F.col("revenue_per_closed_deal"), F.col("median_days_to_close"), rules))
    if grain == "month":
        out = _time_intelligence(out)
    return out


def _time_intelligence(monthly: DataFrame) -> DataFrame:
    """Same month last year and year-to-date.  The calendar has no gaps, so last year is twelve
    rows back; one row per month, whatever the facts hold."""
    every = Window.orderBy("year", "month")
    ytd = Window.partitionBy("year").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select("*", F.lag("revenue_post_signing", 12).over(every).alias("revenue_prev_year"),
                          F.lag("mqls", 12).over(every).alias("mqls_prev_year"),
                          F.sum("revenue_post_signing").over(ytd).alias("revenue_ytd"), F.sum("mqls").over(ytd).alias("mqls_ytd"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (for comparisons across engines)."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
