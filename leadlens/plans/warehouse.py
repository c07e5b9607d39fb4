"""Star-schema build.

``build_warehouse`` turns the ten raw inputs into nine dimensions and two
facts, written once under the shared folder and read back, plus the
seller<->lead bridge that resolves the disjunctive join of the reference's
SQL (J5) once for every analysis.  Each table is a DataFrame over written
files, so a lost executor never renumbers keys.

Every step splits its input once: the rows it keeps, and the rows it leaves out
as (table, key, reason, rows).  What went in, came out and was left out is
stored with the warehouse (``ledger``, ``rejected``), so no audit has to count
the raw inputs again.

Items and orders are clustered by ``order_id`` (``operators.clustered``): an item
row is shuffled once in the whole build, and neither the join of the two facts
nor any later grouping by order (with or without the seller) shuffles again.
An order is the unit of that layout; its rows lie in one bucket.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import clean_label, date_key, day_floor, time_of_day, whole_days
from ..operators.clustered import bucket_count, hash_side, shuffle_count, write_clustered
from ..operators.joins import BROADCAST_MAX_ROWS, broadcast_if, or_join
from ..operators.keys import dense_key, dense_keys_by_group, member_row, running_offsets
from ..session import scratch_path, unique_name
from ..sources.dates import date_dim, input_range
from ..sources.sinks import write_table

UNKNOWN = "unknown"


@dataclass
class Warehouse:
    spark: SparkSession
    path: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    raw: dict[str, DataFrame] = field(default_factory=dict)
    unknown_segment_key: int = 0
    scalars: dict[str, object] = field(default_factory=dict)
    derived_tables: dict[str, DataFrame] = field(default_factory=dict)
    ledger: DataFrame | None = None       # (step, role, table_name, rows): what went in and came out
    rejected: DataFrame | None = None     # (table_name, key, reason, rows): what was left out
    _routes: list[DataFrame] = field(default_factory=list, repr=False)
    _inputs: list[DataFrame] = field(default_factory=list, repr=False)
    _lock: threading.RLock = field(default_factory=threading.RLock, repr=False)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def derived(self, name: str, build: Callable[[], DataFrame], aggregated: bool) -> DataFrame:
        """A table derived from the (immutable) warehouse and shared by several
        analyses: written once under the warehouse folder on first use and read
        back, so later analyses neither recompute it nor depend on executor
        memory.  ``aggregated``: one row per group (e.g. per channel), kept
        apart from row-level tables so plan checks can tell them apart."""
        with self._lock:
            if name not in self.derived_tables:
                path = f"{self.path}/derived/{'aggregate' if aggregated else 'rows'}/{name}"
                write_table(build(), path)
                self.derived_tables[name] = self.spark.read.parquet(path)
            return self.derived_tables[name]

    def scalar(self, name: str, compute: Callable[[], object]) -> object:
        """A one-value aggregate over the written tables, computed once per warehouse."""
        if name not in self.scalars:
            self.scalars[name] = compute()
        return self.scalars[name]

    def dim(self, name: str) -> DataFrame:
        """A dimension, broadcast-hinted when its checked row count allows it."""
        return broadcast_if(self.tables[name], self.rows.get(name))


def _lookup(wh: Warehouse, name: str, *cols: str | Column) -> DataFrame:
    """Columns of a dimension that facts look up: shipped if few rows, else shuffled and hashed."""
    df, rows = wh[name].select(*cols), wh.rows[name]
    return F.broadcast(df) if rows <= BROADCAST_MAX_ROWS else hash_side(df, shuffle_count(wh.spark))


def _earliest(df: DataFrame, key: str, order: list[str], cols: list[str], rows: str = "_rows") -> DataFrame:
    """One row per key: the row with the smallest ``order`` tuple, and in ``rows`` how many the
    key had (deterministic, partial-aggregated, so a hot key never lands whole in one task)."""
    packed = F.min(F.struct(*[F.col(c) for c in order + [c for c in cols if c not in order]]))
    return df.groupBy(key).agg(packed.alias("_m"), F.count(F.lit(1)).alias(rows)).select(key, "_m.*", rows)


REJECT_COLS = "table_name string, key string, reason string, rows long"


def _reject(wh: Warehouse, df: DataFrame, table: str, key: str, reason: str, rows: str) -> None:
    """Adds the groups of ``df`` (over written files) with ``rows`` > 0 to the reject stream."""
    wh._routes.append(df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("key"),
                                F.lit(reason).alias("reason"), F.expr(rows).cast("long").alias("rows")).filter("rows > 0"))


def _count_in(wh: Warehouse, step: str, df: DataFrame, table: str, rows: str) -> None:
    """Adds the rows of ``table`` that reached a step, carried as numbers in its written files."""
    wh._inputs.append(df.agg(F.coalesce(F.sum(F.expr(rows)), F.lit(0)).cast("long").alias("rows")).select(
        F.lit(step).alias("step"), F.lit("in").alias("role"), F.lit(table).alias("table_name"), "rows"))


def _staged(wh: Warehouse, df: DataFrame, name: str) -> DataFrame:
    path = f"{wh.path}/staged/{name}"
    write_table(df, path)
    return wh.spark.read.parquet(path)


def _reject_stream(wh: Warehouse, corrupt: DataFrame | None) -> None:
    """The rows left out by all steps, as a stored table."""
    routes = wh._routes
    if corrupt is not None:
        routes = routes + [corrupt.groupBy(F.col("table").alias("table_name"), F.col("key")).agg(F.count(F.lit(1)).alias("rows"))
                           .select("table_name", "key", F.lit("corrupt").alias("reason"), "rows")]
    write_table(reduce(DataFrame.unionByName, routes), f"{wh.path}/rejected")
    wh.rejected = wh.spark.read.schema(REJECT_COLS).parquet(f"{wh.path}/rejected")


def _ledger(wh: Warehouse) -> None:
    """What went into and came out of every step, as a stored table: numbers of written files only."""
    ledger = wh._inputs + [
        wh.rejected.groupBy("table_name").agg(F.sum("rows").alias("rows"))
        .select(F.lit("rejected").alias("step"), F.lit("rejected").alias("role"), "table_name", "rows"),
        wh.spark.createDataFrame([(n, "out", n, int(k)) for n, k in sorted(wh.rows.items())],
                                 "step string, role string, table_name string, rows long")]
    write_table(reduce(DataFrame.unionByName, ledger), f"{wh.path}/ledger")
    wh.ledger = wh.spark.read.parquet(f"{wh.path}/ledger")


def build_warehouse(spark: SparkSession, raw: dict[str, DataFrame],
                    date_range: tuple[str, str] | None = None, out_path: str | None = None,
                    land: bool = True, corrupt: DataFrame | None = None, id_arm: bool = True) -> Warehouse:
    """``land``: write the raw inputs once as parquet first (right for CSV
    sources, which the build scans several times); otherwise only leads and deals are.  ``corrupt``: (table, key, record) of
    the raw rows that did not parse (``sources.raw.read_rejects``), for the reject stream.
    ``id_arm``: bridge sellers to leads by id as well as by key (D5); without it the leads are
    read once less."""
    path = out_path or scratch_path(spark, "warehouse", unique_name("wh"))
    if land:
        raw = land_raw(spark, raw, f"{path}/raw")
    wh = Warehouse(spark, path, raw=dict(raw))
    if not land:    # read by four steps each, and possibly a plan of joins and groupings: run once
        _concurrently(*[lambda n=n: wh.raw.update({n: _staged(wh, raw[n], n)}) for n in ("mql", "closed_deals")])
        raw = wh.raw

    mql = raw["mql"].withColumn("origin_name", clean_label("origin"))
    closed = raw["closed_deals"].withColumn("segment_name", clean_label("business_segment"))

    # Independent steps run from several driver threads: each is a handful of
    # small jobs, and overlapping them keeps every core busy (phase 1: all
    # dimensions; phase 2: the two facts, which look keys up in them).
    _concurrently(lambda: _lookup_dims(wh, mql, closed),
                  lambda: _date_dim(wh, date_range),
                  lambda: _customer_dim(wh, raw),
                  lambda: _product_dim(wh, raw),
                  lambda: _seller_dim(wh, raw, closed))
    _concurrently(lambda: _fact_lead(wh, mql, closed),
                  lambda: _fact_order_item(wh, raw))

    # --- seller <-> lead bridge: the reference's OR join, resolved once
    bridge = or_join(wh["dim_seller"].select("seller_key", "seller_id"),
                     wh["fact_lead"].select("lead_key", "mql_id", "seller_key", "origin_key",
                                            "segment_key", "is_won"),
                     ("seller_key", "seller_key"), ("seller_id", "mql_id") if id_arm else None,
                     select=[F.col("l.seller_key").alias("seller_key"), F.col("l.seller_id").alias("seller_id"),
                             *[F.col(f"r.{c}") for c in ("lead_key", "mql_id", "origin_key", "segment_key", "is_won")]])

    def write_bridge() -> None:
        wh.rows["seller_lead"] = write_table(bridge, f"{path}/seller_lead", count_rows=True)
        wh.tables["seller_lead"] = spark.read.parquet(f"{path}/seller_lead")

    _concurrently(write_bridge, lambda: _reject_stream(wh, corrupt))
    _ledger(wh)
    return wh


def _concurrently(*steps: Callable[[], None]) -> None:
    """Run independent build steps from driver threads; Spark schedules their jobs side by side."""
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        for f in [pool.submit(step) for step in steps]:
            f.result()


def _lookup_dims(wh: Warehouse, mql: DataFrame, closed: DataFrame) -> None:
    """The five small lookup dimensions in one dense-key pass."""
    spark = wh.spark
    def each(df: DataFrame, **columns: str) -> DataFrame:
        """One row per (dimension, label) of each input row: every input is scanned once."""
        pairs = F.array(*[F.struct(F.lit(d).alias("_dim"), F.col(c).alias("_label")) for d, c in columns.items()])
        return df.select(F.explode(pairs).alias("p")).select("p._dim", "p._label").filter("_label is not null")

    labels = (each(mql, origin="origin_name", landing_page="landing_page_id")
              .unionByName(each(closed, sdr="sdr_id", sr="sr_id", segment="segment_name")))
    keyed, counts = dense_keys_by_group(labels, "_dim", "_label", name="lookup_dims", probe=UNKNOWN)
    for dim, key, label, unknown_member in (("origin", "origin_key", "origin_name", False),
                                            ("landing_page", "landing_page_key", "landing_page_id", True),
                                            ("sdr", "sdr_key", "sdr_id", True),
                                            ("sr", "sr_key", "sr_id", True),
                                            ("segment", "segment_key", "segment_name", False)):
        t = keyed.filter(F.col("_dim") == dim).select(F.col("_key").alias(key), F.col("_label").alias(label))
        n = counts.get(dim, (0, 0))[0]
        if unknown_member:   # D9: unknown member at key 0
            t = t.unionByName(member_row(spark, key, label, 0, UNKNOWN))
            n += 1
        if dim == "segment":
            unknown_seg = counts.get("segment", (0, 0, None))[2]
            if unknown_seg is None:
                # reference appends 'unknown' after the sorted members when absent
                unknown_seg = n + 1
                t = t.unionByName(member_row(spark, "segment_key", "segment_name", unknown_seg, UNKNOWN))
                n += 1
            wh.unknown_segment_key = unknown_seg
        wh.tables[f"dim_{dim}"], wh.rows[f"dim_{dim}"] = t, n


def _date_dim(wh: Warehouse, date_range: tuple[str, str] | None) -> None:
    """Calendar rows of the date range (of the input dates, unless one is given), written once."""
    date_range = date_range or input_range(wh.raw) or ("1970-01-01", "1970-01-01")
    write_table(date_dim(wh.spark, *date_range), f"{wh.path}/dim_date")
    wh.tables["dim_date"] = wh.spark.read.parquet(f"{wh.path}/dim_date")
    wh.rows["dim_date"] = _days(*date_range)


def _customer_dim(wh: Warehouse, raw: dict[str, DataFrame]) -> None:
    """W7 + W4."""
    cust = _earliest(raw["customers"], "customer_id", ["customer_unique_id"],
                     ["customer_city", "customer_state"])
    keyed = _keyed(wh, cust.select("customer_id", "customer_unique_id",
                                   F.col("customer_city").alias("city"), F.col("customer_state").alias("state"), "_rows"),
                   ["customer_id"], "customer_key", "dim_customer")
    _count_in(wh, "dim_customer", keyed, "customers", "_rows")
    _reject(wh, keyed, "customers", "customer_id", "duplicate", "_rows - 1")


def _product_dim(wh: Warehouse, raw: dict[str, DataFrame]) -> None:
    """W6 + W4: products left join the category translation, with defaults."""
    trans = _staged(wh, _earliest(raw["translation"], "product_category_name", ["product_category_name_english"], [],
                                  rows="_translations"), "translation")
    prod = _earliest(raw["products"], "product_id", ["product_category_name", "product_weight_g"], [])
    prod = prod.join(trans, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name", F.lit("outros")).alias("category_name_pt"),
        F.coalesce("product_category_name_english", F.lit("other")).alias("category_name_en"),
        F.coalesce(F.col("product_weight_g").cast("int"), F.lit(0)).alias("weight_g"), "_rows")
    keyed = _keyed(wh, prod, ["product_id"], "product_key", "dim_product")
    _count_in(wh, "dim_product", keyed, "products", "_rows")
    _count_in(wh, "dim_product", trans, "translation", "_translations")
    _reject(wh, keyed, "products", "product_id", "duplicate", "_rows - 1")
    _reject(wh, trans, "translation", "product_category_name", "duplicate", "_translations - 1")


def _seller_dim(wh: Warehouse, raw: dict[str, DataFrame], closed: DataFrame) -> None:
    """W5 + W4 (D10: the earliest deal per seller)."""
    deal_cols = ["mql_id", "won_date", "lead_type", "lead_behaviour_profile", "business_type",
                 "declared_monthly_revenue", "declared_product_catalog_size", "average_stock",
                 "has_company", "has_gtin"]
    deals = _earliest(closed, "seller_id", ["won_date", "mql_id"], deal_cols, rows="_deals")
    sellers = _earliest(raw["sellers"], "seller_id", ["seller_city", "seller_state"], [])
    # sellers and the deals without one, told apart by _rows
    both = _staged(wh, sellers.join(deals, "seller_id", "full").select(
        "seller_id", "won_date",
        F.coalesce("lead_type", F.lit(UNKNOWN)).alias("lead_type"),
        F.coalesce("lead_behaviour_profile", F.lit(UNKNOWN)).alias("lead_behaviour_profile"),
        F.coalesce("business_type", F.lit(UNKNOWN)).alias("business_type"),
        F.coalesce(F.col("declared_monthly_revenue").cast("decimal(12,2)"),
                   F.lit(0).cast("decimal(12,2)")).alias("declared_monthly_revenue"),
        F.coalesce(F.col("declared_product_catalog_size").cast("int"), F.lit(0)).alias("declared_product_catalog_size"),
        F.coalesce("average_stock", F.lit(UNKNOWN)).alias("average_stock"),
        F.coalesce(F.col("has_company").cast("int"), F.lit(0)).alias("has_company"),
        F.coalesce(F.col("has_gtin").cast("int"), F.lit(0)).alias("has_gtin"),
        F.col("seller_city").alias("city"), F.col("seller_state").alias("state"), "_rows", "_deals"), "seller")
    _keyed(wh, both.filter("_rows is not null").drop("_rows", "_deals"), ["seller_id"], "seller_key", "dim_seller")
    _count_in(wh, "dim_seller", both, "sellers", "_rows")
    _count_in(wh, "dim_seller", both, "closed_deals", "_deals")
    _reject(wh, both, "sellers", "seller_id", "duplicate", "_rows - 1")
    _reject(wh, both, "closed_deals", "seller_id", "no_seller", "if(_rows is null, _deals, 0)")
    _reject(wh, both, "closed_deals", "seller_id", "later_deal_of_seller", "if(_rows is null, 0, _deals - 1)")


def _fact_lead(wh: Warehouse, mql: DataFrame, closed: DataFrame) -> None:
    """W8 + W9: one row per MQL, keys looked up in the dimensions."""
    deals = _earliest(closed, "mql_id", ["won_date", "seller_id"], ["sdr_id", "sr_id", "segment_name"], rows="_deals")
    # leads and the deals without one, told apart by _lead
    both = mql.withColumn("_lead", F.lit(True)).join(deals, "mql_id", "full")
    sel = _lookup(wh, "dim_seller", "seller_id", "seller_key")
    leads = (both.withColumn("segment_name", F.coalesce("segment_name", F.lit(UNKNOWN)))
             .join(wh.dim("dim_origin"), "origin_name", "left")
             .join(wh.dim("dim_landing_page"), "landing_page_id", "left")
             .join(wh.dim("dim_segment"), "segment_name", "left")
             .join(wh.dim("dim_sdr"), "sdr_id", "left")
             .join(wh.dim("dim_sr"), "sr_id", "left")
             .join(sel, "seller_id", "left"))
    leads = _staged(wh, leads.select(
        "mql_id",
        date_key("first_contact_date").alias("date_key_first_contact"),
        "origin_key",
        F.coalesce("landing_page_key", F.lit(0).cast("long")).alias("landing_page_key"),
        F.when(F.col("seller_id").isNotNull(), 1).otherwise(0).alias("is_won"),
        date_key("won_date").alias("date_key_won"),
        day_floor("won_date", "first_contact_date").alias("days_to_close"),
        "seller_key",
        F.coalesce("segment_key", F.lit(wh.unknown_segment_key).cast("long")).alias("segment_key"),
        F.coalesce("sdr_key", F.lit(0).cast("long")).alias("sdr_key"),
        F.coalesce("sr_key", F.lit(0).cast("long")).alias("sr_key"), "_lead", "_deals"), "lead")
    _keyed(wh, leads.filter("_lead").drop("_lead", "_deals"), ["mql_id"], "lead_key", "fact_lead",
           tiebreak=["date_key_first_contact"])
    _count_in(wh, "fact_lead", leads, "mql", "if(_lead, 1, 0)")
    _reject(wh, leads, "closed_deals", "mql_id", "no_lead", "if(_lead is null, _deals, 0)")
    # a lead that is there twice takes the same deal twice
    later = leads.filter("_lead and _deals > 1").groupBy("mql_id").agg(F.max("_deals").alias("_deals"))
    _reject(wh, later, "closed_deals", "mql_id", "later_deal_of_lead", "_deals - 1")


# Reasons for which an order item is left out, in the order they are tried.
ITEM_REASONS = {"no_order": "_order is null", "unmapped_seller": "seller_key is null",
                "unmapped_product": "product_key is null", "unmapped_customer": "customer_key is null"}


def _fact_order_item(wh: Warehouse, raw: dict[str, DataFrame]) -> None:
    """One row per order item, numbered by its natural key; all other columns break
    ties, so two builds number alike (rows equal in every column are interchangeable).

    An item's number is the number of items in smaller orders plus its place in its own:
    only orders are sorted across the cluster, items stay in their buckets.  ``order_key``
    numbers orders bucket by bucket, so the keys of a task lie close together
    (``operators.bitmaps``).
    """
    buckets = bucket_count(raw["order_items"], raw["orders"])
    lines, heads = clustered_orders(wh, raw, buckets)
    items = joined_lines(lines, heads, buckets)
    counts = _staged(wh, order_counts(lines, heads, buckets), "order_counts")
    for reason in ITEM_REASONS:
        _reject(wh, counts, "order_items", "order_id", reason, reason)
    offsets, n = running_offsets(counts.filter("_kept > 0"), "order_id", "_kept", "_before", name="order_items")
    orders = write_clustered(offsets.repartition(buckets, "order_id").withColumn("order_key", F.monotonically_increasing_id()),
                             f"{wh.path}/clustered/order_offsets", "order_id", buckets)
    columns = ["order_id", "order_item_id", "date_key_purchase", "seller_key", "product_key", "customer_key", "price",
               "freight_value", "order_status", "review_score", "days_after_won"]
    # order_key stands for order_id and comes first: a number sorts faster than a text
    place = F.row_number().over(Window.partitionBy("order_key", "order_id").orderBy(*columns[1:]))
    fact = (items.filter("reason is null").join(hash_side(orders, buckets), "order_id")
            .select((F.col("_before") + place).alias("order_item_key"), *columns, "order_key"))
    wh.tables["fact_order_item"] = write_clustered(fact, f"{wh.path}/fact_order_item", "order_id", buckets)
    wh.rows["fact_order_item"] = n


def clustered_orders(wh: Warehouse, raw: dict[str, DataFrame], buckets: int) -> tuple[DataFrame, DataFrame]:
    """Items with their seller and product, and orders with their customer and mean review (W11),
    both bucketed by order.  Rows without an order id can meet no order and are only counted."""
    # days since signing are taken apart once per seller and per order, not per item
    seller = _lookup(wh, "dim_seller", "seller_id", "seller_key", F.to_date("won_date").alias("_won_day"),
                     time_of_day("won_date").alias("_won_time"))
    product = _lookup(wh, "dim_product", "product_id", "product_key")
    customer = _lookup(wh, "dim_customer", "customer_id", "customer_key")
    named = F.col("order_id").isNotNull()
    got: dict[str, DataFrame] = {}

    def items() -> None:
        got["lines"] = write_clustered(
            raw["order_items"].filter(named).join(seller, "seller_id", "left").join(product, "product_id", "left").select(
                "order_id", "order_item_id", "seller_key", "_won_day", "_won_time", "product_key",
                F.col("price").cast("decimal(10,2)").alias("price"), F.col("freight_value").cast("decimal(10,2)").alias("freight_value")),
            f"{wh.path}/clustered/order_items", "order_id", buckets)

    def orders() -> None:
        got["reviews"] = write_clustered(raw["order_reviews"].groupBy("order_id").agg(
            F.avg("review_score").alias("_review"), F.count(F.lit(1)).alias("_reviews")),
            f"{wh.path}/clustered/reviews", "order_id", buckets)
        mean = hash_side(got["reviews"].select("order_id", "_review"), buckets)
        got["heads"] = write_clustered(
            raw["orders"].filter(named).select("order_id", "customer_id", "order_status", "order_purchase_timestamp")
            .join(customer, "customer_id", "left").repartition(buckets, "order_id").join(mean, "order_id", "left")
            .select("order_id", "customer_key", "order_status", date_key("order_purchase_timestamp").alias("date_key_purchase"),
                    F.to_date("order_purchase_timestamp").alias("_day"), time_of_day("order_purchase_timestamp").alias("_time"), "_review", F.lit(True).alias("_order")),
            f"{wh.path}/clustered/orders", "order_id", buckets)

    _concurrently(items, orders)
    lines, reviews, heads = got["lines"], got["reviews"], got["heads"]
    for step, table, kept in (("order_items", "order_items", lines), ("orders", "orders", heads)):
        _count_in(wh, step, kept, table, "1")
        nameless = raw[table].filter(~named).select("order_id")
        _count_in(wh, step + "_without_id", nameless, table, "1")
        if table == "order_items":
            wh._routes.append(nameless.groupBy("order_id").agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(table).alias("table_name"), F.col("order_id").alias("key"), F.lit("no_order").alias("reason"), "rows"))
    _count_in(wh, "reviews", reviews, "order_reviews", "_reviews")
    return lines, heads


def joined_lines(lines: DataFrame, heads: DataFrame, buckets: int = 1) -> DataFrame:
    """Items with their order, without a shuffle; ``reason`` says why an item is left out."""
    reason = F.coalesce(*[F.when(F.expr(test), F.lit(r)) for r, test in ITEM_REASONS.items()])
    return lines.join(hash_side(heads, buckets), "order_id", "left").select(
        "order_id", "order_item_id", "date_key_purchase",
        "seller_key", "product_key", "customer_key", "price", "freight_value", "order_status",
        F.bround("_review", 0).cast("int").alias("review_score"),
        whole_days("_day", "_time", "_won_day", "_won_time").alias("days_after_won"), reason.alias("reason"))


def order_counts(lines: DataFrame, heads: DataFrame, buckets: int = 1) -> DataFrame:
    """Per order the items kept (``_kept``) and those left out by reason.  What an item lacks of its own is counted
    before its order is joined, so the join meets one row per order, not per item."""
    own = lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("seller_key").isNull()).alias("_seller"),
        F.count_if(F.col("seller_key").isNotNull() & F.col("product_key").isNull()).alias("_product"))
    rest, known = "_all - _seller - _product", "_order is not null"
    parts = {"_kept": f"if({known} and customer_key is not null, {rest}, 0)", "no_order": f"if({known}, 0, _all)",
             "unmapped_seller": f"if({known}, _seller, 0)", "unmapped_product": f"if({known}, _product, 0)",
             "unmapped_customer": f"if({known} and customer_key is null, {rest}, 0)"}
    # an order that is there twice takes its items twice
    met = own.join(hash_side(heads.select("order_id", "customer_key", "_order"), buckets), "order_id", "left")
    return met.groupBy("order_id").agg(*[F.sum(F.expr(e)).alias(n) for n, e in parts.items()])


def land_raw(spark: SparkSession, raw: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """S2 landing: write each raw input once as parquet and read it back.

    Later steps scan each input several times; landed files are columnar,
    splittable and read in parallel.  An input with fewer splits than the
    cluster has cores (one big row group, a single gzip CSV) is spread with a
    round-robin repartition on the way; a many-file input is written as is.
    """
    target = spark.sparkContext.defaultParallelism
    out = {}
    for name, df in raw.items():
        if df.rdd.getNumPartitions() < target:
            df = df.repartition(target)
        write_table(df, f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}")
    return out


def _keyed(wh: Warehouse, df: DataFrame, order: list[str], key: str, name: str,
           tiebreak: list[str] | None = None) -> DataFrame:
    """Keys ``df`` as the table ``name``; columns that begin with _ stay in the result, which is returned."""
    keyed, wh.rows[name] = dense_key(df, order, key, name=name, tiebreak=tiebreak)
    wh.tables[name] = keyed.select(key, *[c for c in df.columns if not c.startswith("_")])
    return keyed


def _days(start: str, end: str) -> int:
    from datetime import date
    return (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
