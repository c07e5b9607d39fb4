"""Adapter: the driver's TPC-H-like parquet tables -> the ten raw inputs.

An account (``customer``) plays the lead and, once signed, the seller.
The same mapping is spelled in DuckDB SQL in ``leadlens.oracle.sql`` so the
oracle reads identical raw inputs.  Every table is derived by Spark from the
driver tables; nothing is generated on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.partitioning import spread

# Domains used for categorical seller attributes, picked by
# account key modulo the list length (a None member exercises defaults).
LEAD_TYPES = ["online_store", "offline", "industry", "manufacturer", "reseller", None]
BEHAVIOUR_PROFILES = ["cat", "eagle", "wolf", "shark"]
BUSINESS_TYPES = ["reseller", "manufacturer", "other"]
AVERAGE_STOCK = ["1-5", "5-20", "20-50", "50-100", "100-500", "500+"]
UNKNOWN_ORIGIN_SEGMENT = "HOUSEHOLD"        # market segment that becomes a NULL origin
UNTRANSLATED_CATEGORY = "ECONOMY"           # part type left out of the translation table
WON_PRIORITY, WON_STATUS = "1-URGENT", "F"  # orders that count as the signed deal
CANCELED_STATUS = "P"                       # order status mapped to 'canceled'


def pick(values: list[str | None], key_col: str) -> str:
    """SQL CASE text choosing values[key % len(values)]; valid in Spark and DuckDB."""
    n = len(values)
    arms = " ".join(
        f"WHEN {key_col} % {n} = {i} THEN " + ("NULL" if v is None else f"'{v}'")
        for i, v in enumerate(values))
    return f"CASE {arms} END"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a driver table in place (never copied)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw inputs keyed like ``sources.raw.RAW_FILES`` (FIXTURES §3)."""
    customer = _read(spark, sf_dir, "customer")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    part = _read(spark, sf_dir, "part")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")

    first_order = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_contact_date"))
    mql = (customer.join(first_order, customer.c_custkey == first_order.o_custkey)
           .select(_id("m", "c_custkey").alias("mql_id"),
                   F.col("first_contact_date"),
                   _id("lp", "c_nationkey").alias("landing_page_id"),
                   F.when(F.col("c_mktsegment") != UNKNOWN_ORIGIN_SEGMENT,
                          F.col("c_mktsegment")).alias("origin")))

    won = (orders.filter((F.col("o_orderpriority") == WON_PRIORITY)
                         & (F.col("o_orderstatus") == WON_STATUS))
           .groupBy("o_custkey")
           .agg((F.min("o_orderdate") + F.expr("INTERVAL 12 HOURS")).alias("won_date")))
    k = "c_custkey"
    closed = (customer.join(won, customer.c_custkey == won.o_custkey)
              .select(_id("m", k).alias("mql_id"),
                      _id("s", k).alias("seller_id"),
                      F.concat(F.lit("d"), (F.col(k) % 12).cast("string")).alias("sdr_id"),
                      F.concat(F.lit("r"), (F.col(k) % 15).cast("string")).alias("sr_id"),
                      F.col("won_date"),
                      F.concat(F.lit("seg"), (F.col("c_nationkey") % 13).cast("string")).alias("business_segment"),
                      F.expr(pick(LEAD_TYPES, k)).alias("lead_type"),
                      F.expr(pick(BEHAVIOUR_PROFILES, k)).alias("lead_behaviour_profile"),
                      (F.col(k) % 2).cast("int").alias("has_company"),
                      F.when(F.col(k) % 3 == 0, 1).otherwise(0).alias("has_gtin"),
                      F.expr(pick(AVERAGE_STOCK, k)).alias("average_stock"),
                      F.expr(pick(BUSINESS_TYPES, k)).alias("business_type"),
                      (F.col(k) % 200).cast("int").alias("declared_product_catalog_size"),
                      F.col("c_acctbal").cast("decimal(12,2)").alias("declared_monthly_revenue")))

    geo = (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
           .join(region, nation.n_regionkey == region.r_regionkey))
    sellers = geo.select(_id("s", k).alias("seller_id"),
                         (F.lit(10000) + F.col(k) % 90000).cast("int").alias("seller_zip_code_prefix"),
                         F.col("n_name").alias("seller_city"),
                         F.col("r_name").alias("seller_state"))
    customers = geo.select(_id("c", k).alias("customer_id"),
                           _id("u", k).alias("customer_unique_id"),
                           (F.lit(10000) + F.col(k) % 90000).cast("int").alias("customer_zip_code_prefix"),
                           F.col("n_name").alias("customer_city"),
                           F.col("r_name").alias("customer_state"))

    raw_orders = orders.select(
        _id("o", "o_orderkey").alias("order_id"),
        _id("c", "o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == CANCELED_STATUS, "canceled").otherwise("delivered").alias("order_status"),
        (F.col("o_orderdate")
         + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))).alias("order_purchase_timestamp"))

    price = F.col("l_extendedprice").cast("decimal(10,2)")
    # items carry the fact's volume: spread them; reviews only feed a per-order
    # mean, which combines map-side, so they stay unspread.  Items meet their order by
    # ``order_id``, by which the build clusters them: they are shuffled once for both
    li = spread(lineitem.select(_id("o", "l_orderkey").alias("order_id"), "l_partkey", "l_linenumber", "l_shipdate",
                                "l_extendedprice", "l_tax"))
    items = (li.join(orders.select(_id("o", "o_orderkey").alias("order_id"), "o_custkey"), "order_id")
             .select("order_id",
                     F.col("l_linenumber").alias("order_item_id"),
                     _id("p", "l_partkey").alias("product_id"),
                     _id("s", "o_custkey").alias("seller_id"),
                     F.col("l_shipdate").alias("shipping_limit_date"),
                     price.alias("price"),
                     (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(10,2)").alias("freight_value")))

    reviews = lineitem.select(
        F.concat(F.lit("v"), F.col("l_orderkey").cast("string"), F.lit("_"),
                 F.col("l_linenumber").cast("string")).alias("review_id"),
        _id("o", "l_orderkey").alias("order_id"),
        (F.lit(1) + F.col("l_quantity") % 5).cast("int").alias("review_score"))

    products = part.select(_id("p", "p_partkey").alias("product_id"),
                           F.col("p_type").alias("product_category_name"),
                           F.col("p_size").alias("product_weight_g"))
    translation = (part.select("p_type").filter(F.col("p_type") != UNTRANSLATED_CATEGORY).distinct()
                   .select(F.col("p_type").alias("product_category_name"),
                           F.lower("p_type").alias("product_category_name_english")))

    return {
        "mql": mql, "closed_deals": closed, "orders": raw_orders, "order_items": items,
        "order_reviews": reviews, "customers": customers, "sellers": sellers,
        "products": products, "translation": translation,
    }
