"""Post-signing revenue, activation and cohort analyses.

Shape of every plan here: the order-item fact is reduced per seller first
(partial + final hash aggregation, so a seller holding a third of all items
is split across map tasks), then joined to the seller->channel bridge, which
is one row per signed seller.  The reference's SQL joins item rows to the
bridge and then sums; a bridge multiplicity column keeps those sums exact
when a seller maps to several leads of the same group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_bucket, safe_ratio
from ..operators.aggregates import nearest_rank_percentiles
from ..operators.bitmaps import distinct_counts
from .warehouse import Warehouse


# ----------------------------------------------------------------- building blocks
def post_signing_items(wh: Warehouse, exclude_canceled: bool) -> DataFrame:
    """P1 (+P2): items on/after the seller's signing day, optionally without canceled."""
    items = wh["fact_order_item"].filter(F.col("days_after_won") >= 0)
    if exclude_canceled:
        items = items.filter(F.col("order_status") != "canceled")
    return items


def seller_order_totals(items: DataFrame) -> DataFrame:
    """Per (seller, order) partial sums: one scan of the item fact serves both the
    per-seller sums and every distinct-order count built on top of it (a branch
    per purpose would scan the fact twice, since the two branches prune the
    aggregate differently and cannot share its shuffle).  The fact is bucketed by
    order, so this grouping does not shuffle."""
    return items.groupBy("seller_key", "order_id", "order_key").agg(
        F.sum("price").alias("o_revenue"),
        F.sum("freight_value").alias("o_freight"),
        F.count(F.lit(1)).alias("o_items"),
        F.sum("review_score").alias("o_review_sum"),
        F.count("review_score").alias("o_review_n"),
        F.min("days_after_won").alias("o_first_days"))


def seller_totals_with_orders(items: DataFrame) -> DataFrame:
    """Per-seller sums plus ``s_orders`` (distinct orders), from one scan."""
    return seller_order_totals(items).groupBy("seller_key").agg(
        F.sum("o_revenue").alias("s_revenue"),
        F.sum("o_freight").alias("s_freight"),
        F.sum("o_items").alias("s_items"),
        F.sum("o_review_sum").alias("s_review_sum"),
        F.sum("o_review_n").alias("s_review_n"),
        F.min("o_first_days").alias("s_first_days"),
        F.count(F.lit(1)).alias("s_orders"))


def bridge(wh: Warehouse, *group: str) -> DataFrame:
    """Seller -> group (e.g. lead_origin) with the number of bridge rows per pair.

    Shared by most revenue analyses, so each grouping is written once per
    warehouse (one row per seller and group: row-level, not per-group)."""
    name = "bridge_" + "_".join(group)
    return wh.derived(name, lambda: _bridge(wh, *group), aggregated=False)


def _bridge(wh: Warehouse, *group: str) -> DataFrame:
    b = wh["seller_lead"]
    cols = []
    for g in group:
        if g == "lead_origin":
            b = b.join(wh.dim("dim_origin"), "origin_key")
            cols.append(F.col("origin_name").alias("lead_origin"))
        elif g == "business_segment":
            b = b.join(wh.dim("dim_segment"), "segment_key")
            cols.append(F.col("segment_name").alias("business_segment"))
        else:
            cols.append(F.col(g))
    return b.groupBy("seller_key", *cols).agg(F.count(F.lit(1)).alias("mult"))


def _bridge_rows(wh: Warehouse) -> int:
    return wh.rows.get("seller_lead", 0)


def rollup(wh: Warehouse, items: DataFrame, group: list[str]) -> DataFrame:
    """Item metrics at a bridge grain: sums weighted by multiplicity, exact distinct counts.

    One scan: per-(seller, order) partials joined to the bridge, then one
    aggregation holds the weighted sums and, as bitmaps, both distinct counts.
    """
    from ..operators.joins import broadcast_if
    b = broadcast_if(bridge(wh, *group), _bridge_rows(wh))
    per = seller_order_totals(items).join(b, "seller_key")
    m = F.col("mult")
    return distinct_counts(per, group, {"active_sellers": F.col("seller_key"), "orders": F.col("order_key")}, {
        "revenue": F.col("o_revenue") * m, "freight": F.col("o_freight") * m, "items": F.col("o_items") * m,
        "review_sum": F.col("o_review_sum") * m, "review_n": F.col("o_review_n") * m})


# ----------------------------------------------------------------- C12 and view 4
def channel_matrix(wh: Warehouse) -> DataFrame:
    """Master channel efficiency matrix (view 5)."""
    leads = wh["fact_lead"].join(wh.dim("dim_origin"), "origin_key")
    mql = leads.groupBy(F.col("origin_name").alias("lead_origin")).agg(
        F.count("lead_key").alias("total_mqls"),
        F.sum("is_won").cast("long").alias("closed_deals"),
        F.avg(F.when(F.col("is_won") == 1, F.col("days_to_close"))).alias("avg_days_to_close"))
    rev = rollup(wh, post_signing_items(wh, exclude_canceled=True), ["lead_origin"])
    j = mql.join(rev, "lead_origin", "left")
    active = F.coalesce("active_sellers", F.lit(0)).cast("long")
    revenue = F.coalesce(F.col("revenue").cast("double"), F.lit(0.0))
    return j.select(
        "lead_origin", "total_mqls", "closed_deals",
        safe_ratio("closed_deals", "total_mqls").alias("conversion_rate"),
        "avg_days_to_close",
        active.alias("active_sellers"),
        safe_ratio(active, "closed_deals").alias("activation_rate"),
        F.coalesce("orders", F.lit(0)).cast("long").alias("total_orders"),
        revenue.alias("total_post_signing_revenue"),
        safe_ratio(revenue, "closed_deals").alias("revenue_per_closed_deal"),
        F.coalesce(safe_ratio("review_sum", "review_n"), F.lit(0.0)).alias("avg_review_score"))


def shared_channel_matrix(wh: Warehouse) -> DataFrame:
    """C12 as the shared input of ROI, recommendations, anomalies, scenarios and KPIs:
    one row per channel, computed once per warehouse."""
    return wh.derived("channel_matrix", lambda: channel_matrix(wh), aggregated=True)


def cohort_matrix(wh: Warehouse) -> DataFrame:
    """C11 (view 4): channel x 30-day month since signing, no month cap."""
    items = post_signing_items(wh, exclude_canceled=True).withColumn(
        "months_since_signing", month_bucket("days_after_won"))
    return _month_rollup(wh, items).select(
        "lead_origin", "months_since_signing", "active_sellers",
        F.col("revenue").cast("double").alias("monthly_revenue"))


def _month_rollup(wh: Warehouse, items: DataFrame) -> DataFrame:
    """Per (channel, month): distinct active sellers and weighted revenue."""
    from ..operators.joins import broadcast_if
    b = broadcast_if(bridge(wh, "lead_origin"), _bridge_rows(wh))
    per = (items.groupBy("seller_key", "months_since_signing")
           .agg(F.sum("price").alias("s_revenue"))
           .join(b, "seller_key"))
    # a seller is there once per channel and month, so its rows are counted
    return per.groupBy("lead_origin", "months_since_signing").agg(
        F.count("seller_key").alias("active_sellers"),
        F.sum(F.col("s_revenue") * F.col("mult")).alias("revenue"))


def cohort_revenue(wh: Warehouse, max_month: int = 12) -> DataFrame:
    """Months 0..12 since signing, monthly and cumulative revenue per channel."""
    items = (post_signing_items(wh, exclude_canceled=True)
             .withColumn("months_since_signing", month_bucket("days_after_won"))
             .filter(F.col("months_since_signing").between(0, max_month)))        # P4
    m = _month_rollup(wh, items)
    w = (Window.partitionBy("lead_origin").orderBy("months_since_signing")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))            # N6, <=13 rows/channel
    return m.select(
        "lead_origin", "months_since_signing",
        F.col("active_sellers").alias("active_sellers_in_month"),
        F.round("revenue", 2).cast("double").alias("monthly_revenue"),
        F.round(F.sum("revenue").over(w), 2).cast("double").alias("cumulative_cohort_revenue"),
    ).orderBy("lead_origin", "months_since_signing")


# ----------------------------------------------------------------- C5 (SQL 04)
def seller_revenue_by_origin(wh: Warehouse) -> DataFrame:
    """Post-signing revenue and seller performance per channel, ranked."""
    won = (wh["fact_lead"].filter(F.col("is_won") == 1).join(wh.dim("dim_origin"), "origin_key")
           .groupBy(F.col("origin_name").alias("lead_origin"))
           .agg(F.countDistinct("seller_key").alias("total_closed_deals"),
                F.count("lead_key").alias("total_mqls")))
    items = post_signing_items(wh, exclude_canceled=True)
    # per (seller, channel) rows, as the reference's first CTE
    b = bridge(wh, "lead_origin")
    per_seller = seller_totals_with_orders(items).join(b, "seller_key")
    m = F.col("mult")
    per_seller = per_seller.select(
        "lead_origin", "seller_key",
        F.col("s_orders").alias("total_orders"),
        (F.col("s_revenue") * m).alias("rev"),
        (F.col("s_freight") * m).alias("freight"),
        ((F.col("s_revenue") + F.col("s_freight")) * m).alias("gmv"),
        safe_ratio("s_review_sum", "s_review_n").alias("avg_review"))
    by_origin = per_seller.groupBy("lead_origin").agg(
        F.countDistinct("seller_key").alias("active_sellers"),
        F.sum("total_orders").alias("orders"),
        F.sum("rev").alias("rev"), F.sum("freight").alias("freight"), F.sum("gmv").alias("gmv"),
        F.avg("avg_review").alias("avg_review"))
    j = won.join(by_origin, "lead_origin", "left")
    rev_d = F.col("rev").cast("double")
    active = F.coalesce("active_sellers", F.lit(0)).cast("long")
    rank_key = F.coalesce(F.try_divide(rev_d, F.col("total_closed_deals").cast("double")), F.lit(0.0))
    out = j.select(
        "lead_origin", "total_mqls", "total_closed_deals",
        active.alias("active_sellers"),
        F.round(safe_ratio(active, "total_closed_deals"), 4).alias("seller_activation_rate"),
        F.coalesce("orders", F.lit(0)).cast("long").alias("total_post_signing_orders"),
        F.coalesce(F.round("rev", 2).cast("double"), F.lit(0.0)).alias("total_post_signing_revenue"),
        F.coalesce(F.round(safe_ratio(rev_d, "total_closed_deals"), 2), F.lit(0.0)).alias("revenue_per_closed_deal"),
        F.coalesce(F.round(safe_ratio(rev_d, active), 2), F.lit(0.0)).alias("revenue_per_active_seller"),
        F.coalesce(F.round(safe_ratio(rev_d, "orders"), 2), F.lit(0.0)).alias("average_order_value_aov"),
        F.coalesce(F.round(safe_ratio(F.col("freight").cast("double"), F.col("gmv").cast("double")), 4),
                   F.lit(0.0)).alias("freight_revenue_share"),
        F.coalesce(F.round("avg_review", 2), F.lit(0.0)).alias("avg_review_score"),
        rank_key.alias("_rank_key"))
    rank = F.dense_rank().over(Window.orderBy(F.desc("_rank_key"))).cast("int")   # one row per channel
    return (out.withColumn("revenue_per_deal_rank", rank).drop("_rank_key")
               .orderBy(F.desc("total_post_signing_revenue")))


# ----------------------------------------------------------------- C6
def first_order_by_origin(wh: Warehouse) -> DataFrame:
    """Days from signing to a seller's first post-signing order, per channel."""
    items = post_signing_items(wh, exclude_canceled=True)
    first = items.groupBy("seller_key").agg(F.min("days_after_won").alias("days_to_first_order"))
    sellers = bridge(wh, "lead_origin").select("seller_key", "lead_origin").distinct()
    j = sellers.join(first, "seller_key", "left")
    base = j.groupBy("lead_origin").agg(
        F.count(F.lit(1)).alias("closed_sellers"),
        F.count("days_to_first_order").alias("activated_sellers"),
        F.avg("days_to_first_order").alias("_avg"))
    med = nearest_rank_percentiles(j, ["lead_origin"], "days_to_first_order", {"median_days_to_first_order": 50})
    return (base.join(med.select("lead_origin", "median_days_to_first_order"), "lead_origin", "left")
            .select("lead_origin", "closed_sellers", "activated_sellers",
                    F.round(safe_ratio("activated_sellers", "closed_sellers"), 4).alias("activation_share"),
                    F.round("_avg", 2).alias("avg_days_to_first_order"),
                    "median_days_to_first_order"))


# ----------------------------------------------------------------- view 2, view 3
def lead_time_to_close(wh: Warehouse) -> DataFrame:
    """C9 (view 2): one row per lead with channel and segment."""
    return (wh["fact_lead"].join(wh.dim("dim_origin"), "origin_key")
            .join(wh.dim("dim_segment"), "segment_key")
            .select(F.col("origin_name").alias("lead_origin"),
                    F.col("segment_name").alias("business_segment"),
                    "mql_id", "days_to_close", "is_won"))


def seller_post_signing(wh: Warehouse) -> DataFrame:
    """C10 (view 3): every signed seller, inactive ones kept with NULL sums; canceled included.

    Read by the view query and the measures (M10): written once per warehouse
    (one row per seller, channel and segment: row-level)."""
    return wh.derived("seller_post_signing", lambda: _seller_post_signing(wh), aggregated=False)


def _seller_post_signing(wh: Warehouse) -> DataFrame:
    items = wh["fact_order_item"].filter(F.col("days_after_won") >= 0)   # J4: predicate in the ON
    per = seller_totals_with_orders(items)
    sel = wh["dim_seller"].select("seller_key", "seller_id", "lead_type", "lead_behaviour_profile",
                                  "declared_monthly_revenue")
    b = (wh["seller_lead"].join(wh.dim("dim_origin"), "origin_key").join(wh.dim("dim_segment"), "segment_key")
         .groupBy("seller_key", F.col("origin_name").alias("lead_origin"),
                  F.col("segment_name").alias("business_segment"))
         .agg(F.count(F.lit(1)).alias("mult")))
    j = b.join(sel, "seller_key").join(per, "seller_key", "left")
    m = F.col("mult")
    return j.select(
        "seller_id", "seller_key", "lead_origin", "business_segment", "lead_type",
        "lead_behaviour_profile", "declared_monthly_revenue",
        F.coalesce("s_orders", F.lit(0)).cast("long").alias("total_orders"),
        (F.col("s_revenue") * m).alias("total_revenue"),
        (F.col("s_freight") * m).alias("total_freight"),
        safe_ratio("s_review_sum", "s_review_n").alias("avg_review_score"),
        F.col("s_first_days").alias("days_to_first_order"))


# ----------------------------------------------------------------- C15
def segment_performance(wh: Warehouse) -> DataFrame:
    """Revenue, orders and review per business segment (all leads; canceled kept)."""
    # (segment, seller) pairs with the number of leads behind each; the seller
    # side is the LEFT JOIN to dim_seller, so unknown sellers count as NULL
    sel_keys = wh["dim_seller"].select("seller_key", F.col("seller_key").alias("sel_key"))
    pairs = (wh["fact_lead"].groupBy("segment_key", "seller_key").agg(F.count(F.lit(1)).alias("mult"))
             .join(sel_keys, "seller_key", "left")
             .groupBy("segment_key", "sel_key").agg(F.sum("mult").alias("mult"))
             .join(wh.dim("dim_segment"), "segment_key")
             .select("segment_name", F.col("sel_key").alias("seller_key"), "mult"))
    items = wh["fact_order_item"].filter(F.col("days_after_won") >= 0)
    m = F.col("mult")
    # sellers per segment need no items; the per-(seller, order) partials come in by an
    # inner join, whose hot sellers AQE can split, and meet the segments afterwards
    base = pairs.groupBy("segment_name").agg(F.countDistinct("seller_key").alias("closed_sellers"))
    sold = (pairs.filter(F.col("seller_key").isNotNull()).join(seller_order_totals(items), "seller_key")
            .groupBy("segment_name").agg(
                F.countDistinct("order_id").alias("orders"),
                F.sum(F.col("o_revenue") * m).alias("rev"),
                F.sum(F.col("o_review_sum") * m).alias("review_sum"),
                F.sum(F.col("o_review_n") * m).alias("review_n")))
    sums = base.join(sold, "segment_name", "left")
    return (sums.select(
        "segment_name", "closed_sellers",
        F.coalesce(F.col("rev").cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce("orders", F.lit(0)).cast("long").alias("total_orders"),
        F.coalesce(F.round(safe_ratio("review_sum", "review_n"), 2), F.lit(0.0)).alias("avg_review_score"))
        .orderBy(F.desc("total_revenue")))


# ----------------------------------------------------------------- C17
def revenue_sensitivity(wh: Warehouse, windows: tuple[int, ...] = (90, 180, 365)) -> DataFrame:
    """C17: revenue and revenue per deal within N days of signing, per channel, one pass."""
    won = wh["fact_lead"].filter(F.col("is_won") == 1).join(wh.dim("dim_origin"), "origin_key")
    deals = won.groupBy(F.col("origin_name").alias("origin")).agg(F.count(F.lit(1)).alias("closed_deals"))
    sellers = won.filter(F.col("seller_key").isNotNull()).select(
        F.col("origin_name").alias("origin"), "seller_key").distinct()               # J7 semantics
    items = wh["fact_order_item"].filter(F.col("days_after_won") >= 0)
    per = items.groupBy("seller_key").agg(*[                                          # P5
        F.sum(F.when(F.col("days_after_won") <= w, F.col("price"))).alias(f"s{w}") for w in windows])
    sums = sellers.join(per, "seller_key").groupBy("origin").agg(
        *[F.sum(f"s{w}").alias(f"r{w}") for w in windows])
    j = deals.join(sums, "origin", "left")
    cols = ["origin", "closed_deals"]
    for w in windows:
        r = F.coalesce(F.col(f"r{w}").cast("double"), F.lit(0.0))
        cols += [F.round(r, 2).alias(f"rev_{w}d"),
                 F.coalesce(F.round(safe_ratio(r, "closed_deals"), 2), F.lit(0.0)).alias(f"rev_per_deal_{w}d")]
    return j.select(*cols).orderBy(F.desc(f"rev_{windows[-1]}d"))
