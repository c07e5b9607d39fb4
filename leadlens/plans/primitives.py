"""Primitive operators not isolated by a composite query.

Each runs over whole warehouse tables and exercises one operator:
J4 J5 J7 J8 J9, A2 A9 A10 A15, N4 N6, O3/O4, U1 U2, F10 F11 F14.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_bucket, pretty_label, ratio_or, short_id
from ..operators.bitmaps import distinct_counts
from ..operators.joins import anti, broadcast_if, left_join_on_predicate, or_join, semi
from ..operators.quantiles import interpolated_quantiles
from ..sources.published import month_of, publish, published
from .channel import cac_column
from .revenue import bridge, post_signing_items, shared_channel_matrix
from .warehouse import Warehouse


def left_on_predicate(wh: Warehouse) -> DataFrame:
    """Every seller, with post-signing item count/revenue (0 when none): the day
    predicate sits in the ON clause, so sellers without such items stay."""
    per = (wh["fact_order_item"].groupBy("seller_key", (F.col("days_after_won") >= 0).alias("post"))
           .agg(F.count(F.lit(1)).alias("n_items"), F.sum("price").alias("rev")))
    j = left_join_on_predicate(wh["dim_seller"].select("seller_key", "seller_id"), per, "seller_key", F.col("post"))
    return j.select("seller_key", "seller_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce(F.col("rev").cast("double"), F.lit(0.0)).alias("revenue"))


def or_join_pairs(wh: Warehouse) -> DataFrame:
    """(seller, lead) pairs with seller_key = lead.seller_key OR seller_id = lead.mql_id."""
    return or_join(wh["dim_seller"].select("seller_key", "seller_id"),
                   wh["fact_lead"].select("lead_key", "mql_id", "seller_key"),
                   ("seller_key", "seller_key"), ("seller_id", "mql_id"),
                   select=[F.col("l.seller_id").alias("seller_id"), F.col("r.mql_id").alias("mql_id")])


def _active_sellers(wh: Warehouse) -> DataFrame:
    """Distinct sellers with a post-signing item; a hot seller's items combine before the shuffle,
    so the right side of a semi or anti join holds one row per key."""
    return wh["fact_order_item"].filter(F.col("days_after_won") >= 0).select("seller_key").distinct()


def sellers_with_sales(wh: Warehouse) -> DataFrame:
    """Sellers with at least one post-signing item (semi join)."""
    return semi(wh["dim_seller"].select("seller_key", "seller_id"), _active_sellers(wh), "seller_key")


def sellers_without_sales(wh: Warehouse) -> DataFrame:
    """Sellers with no post-signing order item (anti join)."""
    return anti(wh["dim_seller"].select("seller_key", "seller_id"), _active_sellers(wh), "seller_key")


def default_lookup(wh: Warehouse) -> DataFrame:
    """Acquisition cost per channel, default when the channel is not listed."""
    return shared_channel_matrix(wh).select("lead_origin", cac_column("lead_origin").alias("est_cac"))


def count_distinct(wh: Warehouse) -> DataFrame:
    """A2: distinct orders, sellers and customers per order status."""
    return distinct_counts(wh["fact_order_item"], ["order_status"], {
        "orders": F.col("order_key"), "sellers": F.col("seller_key"), "customers": F.col("customer_key")})


def interpolated_pct(wh: Warehouse) -> DataFrame:
    """Interpolated median and P75 of days to close per channel (PERCENTILE.INC)."""
    won = wh["fact_lead"].filter(F.col("is_won") == 1).join(wh.dim("dim_origin"), "origin_key")
    return won.groupBy(F.col("origin_name").alias("lead_origin")).agg(
        F.round(F.percentile("days_to_close", F.lit(0.5)), 6).alias("median_days"),
        F.round(F.percentile("days_to_close", F.lit(0.75)), 6).alias("p75_days"))


def stddev(wh: Warehouse) -> DataFrame:
    """A10: sample standard deviation of days to close per segment (NULL for one deal)."""
    won = wh["fact_lead"].filter(F.col("is_won") == 1).join(wh.dim("dim_segment"), "segment_key")
    return won.groupBy("segment_name").agg(F.round(F.stddev_samp("days_to_close"), 6).alias("sd_days"))


def benchmark_all(wh: Warehouse) -> DataFrame:
    """Channel conversion next to the all-channel benchmark (one row per channel)."""
    c = (wh["fact_lead"].join(wh.dim("dim_origin"), "origin_key").groupBy(F.col("origin_name").alias("lead_origin"))
         .agg(F.count(F.lit(1)).alias("mqls"), F.sum("is_won").alias("won")))
    every = Window.partitionBy()
    conv = ratio_or("won", "mqls")
    overall = ratio_or(F.sum("won").over(every), F.sum("mqls").over(every))
    return c.select("lead_origin", F.round(conv, 6).alias("conversion_rate"),
                    F.round(overall, 6).alias("overall_conversion_rate"),
                    F.round(conv - overall, 6).alias("vs_overall"))


def running_sum(wh: Warehouse) -> DataFrame:
    """Leads per contact month and the running total per channel."""
    m = (wh["fact_lead"].join(wh.dim("dim_origin"), "origin_key")
         .groupBy(F.col("origin_name").alias("lead_origin"),
                  (F.floor(F.col("date_key_first_contact") / 100)).cast("int").alias("year_month"))
         .agg(F.count(F.lit(1)).alias("mqls")))
    w = Window.partitionBy("lead_origin").orderBy("year_month").rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("cumulative_mqls", F.sum("mqls").over(w))


def dense_rank(wh: Warehouse) -> DataFrame:
    """Channels dense-ranked by lead volume (ties share a rank)."""
    c = (wh["fact_lead"].join(wh.dim("dim_origin"), "origin_key")
         .groupBy(F.col("origin_name").alias("lead_origin")).agg(F.count(F.lit(1)).alias("mqls")))
    return c.withColumn("volume_rank", F.dense_rank().over(Window.orderBy(F.desc("mqls"))).cast("int"))


def top_k(wh: Warehouse, k: int = 3) -> DataFrame:
    """The k channels with the most post-signing revenue (the report is a top-k)."""
    return (shared_channel_matrix(wh).select("lead_origin", "total_post_signing_revenue")
            .orderBy(F.desc("total_post_signing_revenue"), "lead_origin").limit(k))


def set_difference(wh: Warehouse) -> DataFrame:
    """Signed sellers never activated after signing (EXCEPT on distinct keys)."""
    signed = wh["fact_lead"].select("seller_key").filter(F.col("seller_key").isNotNull())
    return signed.distinct().subtract(_active_sellers(wh))


def set_intersection(wh: Warehouse) -> DataFrame:
    """Raw signed-seller ids that also appear in order items (INTERSECT)."""
    r = wh.raw
    return (r["closed_deals"].select("seller_id").filter(F.col("seller_id").isNotNull())
            .distinct().intersect(r["order_items"].select("seller_id").distinct()))


def union_member(wh: Warehouse) -> DataFrame:
    """Cleaned deal segments plus the 'unknown' member, distinct."""
    from ..functions.exprs import clean_label
    segs = wh.raw["closed_deals"].select(clean_label("business_segment").alias("segment_name"))
    member = wh.spark.range(0, 1, 1, 1).select(F.lit("unknown").alias("segment_name"))   # one row, one partition
    return segs.unionByName(member).distinct()


def month_buckets(wh: Warehouse) -> DataFrame:
    """post-signing items per 30-day month since signing."""
    return (wh["fact_order_item"].filter(F.col("days_after_won") >= 0)
            .groupBy(month_bucket("days_after_won").alias("months_since_signing"))
            .agg(F.count(F.lit(1)).alias("items")))


def day_floor_hist(wh: Warehouse) -> DataFrame:
    """every value of the floored day offset purchase - signing, with its count."""
    return wh["fact_order_item"].groupBy("days_after_won").agg(F.count(F.lit(1)).alias("items"))


def labels(wh: Warehouse) -> DataFrame:
    """display label of the channel and short lead id, for every lead."""
    return (wh["fact_lead"].join(wh.dim("dim_origin"), "origin_key")
            .select("mql_id", short_id("mql_id", 3).alias("short_id"), pretty_label("origin_name").alias("origin_label")))


def price_quantiles(wh: Warehouse, qs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """A9 over an unbounded domain: interpolated quantiles of the item price per order status, in cents
    while they are searched for."""
    items = wh["fact_order_item"].select("order_status", (F.col("price") * 100).cast("long").alias("cents"))
    return (interpolated_quantiles(items, ["order_status"], "cents", list(qs))
            .select("order_status", "q", F.round(F.col("cents") / 100, 6).alias("price")))


def sketched_orders(wh: Warehouse, log_k: int = 12) -> DataFrame:
    """A2 by stored sketches: orders per channel from (channel, day) HyperLogLog sketches, beside the exact
    count; ``within_error`` says whether they differ by at most three standard errors (1.04 / sqrt(2^log_k) each)."""
    def build() -> DataFrame:
        items = post_signing_items(wh, exclude_canceled=True)
        b = broadcast_if(bridge(wh, "lead_origin").select("seller_key", "lead_origin"), wh.rows.get("seller_lead"))
        per = items.groupBy("seller_key", "order_id", "order_key", "date_key_purchase").agg(F.lit(1).alias("_one")).join(b, "seller_key")
        return per.groupBy("lead_origin", F.col("date_key_purchase").alias("date_key")).agg(F.hll_sketch_agg("order_key", F.lit(log_k)).alias("orders"))

    sketches = wh.derived(f"order_sketches_{log_k}", build, aggregated=True)
    about = sketches.groupBy("lead_origin").agg(F.hll_sketch_estimate(F.hll_union_agg("orders")).alias("estimate"))
    exact = shared_channel_matrix(wh).filter("total_orders > 0").select("lead_origin", F.col("total_orders").alias("orders"))
    bound = F.col("orders") * (3 * 1.04 / (1 << log_k) ** 0.5)
    return exact.join(about, "lead_origin", "left").select(
        "lead_origin", "orders", (F.abs(F.col("estimate") - F.col("orders")) <= F.greatest(bound, F.lit(1.0))).alias("within_error"))


def published_facts(wh: Warehouse) -> DataFrame:
    """Both facts refreshed as month-partitioned published versions and read back from them, by month."""
    parts = []
    for name, key, amount in (("fact_lead", "date_key_first_contact", F.col("is_won")), ("fact_order_item", "date_key_purchase", F.col("price"))):
        root = f"{wh.path}/published/{name}"
        publish(wh[name].withColumn("year_month", month_of(key)), root, "year_month")
        parts.append(published(wh.spark, root).groupBy("year_month").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(amount).cast("double").alias("amount"))
            .select(F.lit(name).alias("fact"), F.col("year_month").cast("int").alias("year_month"), "n_rows", "amount"))
    return parts[0].unionByName(parts[1])


def or_join_key_arm(wh: Warehouse) -> DataFrame:
    """J5 with its key arm only (D5): (seller, lead) pairs with seller_key = lead.seller_key."""
    return or_join(wh["dim_seller"].select("seller_key", "seller_id"),
                   wh["fact_lead"].select("lead_key", "mql_id", "seller_key"),
                   ("seller_key", "seller_key"), None,
                   select=[F.col("l.seller_id").alias("seller_id"), F.col("r.mql_id").alias("mql_id")])
