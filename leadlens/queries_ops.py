"""Registrations of the chart datasets (G1-G3) and primitive-operator queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .oracle import sql as O
from .oracle.sql import rnd
from .plans import charts, primitives as P
from .plans.revenue import shared_channel_matrix
from .plans.warehouse import Warehouse
from .queries_analytics import CHANNEL_MATRIX_CTE, _cac_sql, _W3
from .queries_stats import _CI_SELECT, _KM
from .registry import ORACLE, register
from .session import scratch_path, unique_name
from .sources.raw import RAW_SCHEMAS, outcomes, read_csv, read_processed
from .sources.sinks import write_csv, write_json

# ---------------------------------------------------------------- charts
_WF = f"""wf AS (SELECT o.origin_name AS origin, {rnd(_W3[0], 4)} AS conversion_rate,
              {rnd(_W3[1], 4)} AS wilson_ci_lower, {rnd(_W3[2], 4)} AS wilson_ci_upper
       FROM fact_lead f JOIN dim_origin o ON f.origin_key = o.origin_key GROUP BY o.origin_name)"""


@register("chart_funnel_error", O.q(f"""
SELECT origin, {rnd('conversion_rate * 100', 2)} AS rate_pct,
       {rnd('conversion_rate * 100 - wilson_ci_lower * 100', 2)} AS err_low,
       {rnd('wilson_ci_upper * 100 - conversion_rate * 100', 2)} AS err_high FROM wf""", _WF))
def q_chart_funnel_error(wh: Warehouse) -> DataFrame:
    """G1 error-bar frame of the Wilson funnel."""
    return charts.funnel_error_bars(wh)


@register("chart_km_top6", O.q(f"""
SELECT origin, CAST(ROW_NUMBER() OVER (PARTITION BY origin ORDER BY o_, t) - 1 AS INTEGER) AS point,
       t AS "time", survival
FROM (SELECT origin, 0 AS o_, 0 AS t, CAST(1.0 AS DOUBLE) AS survival FROM top6
      UNION ALL SELECT h3.origin, 1, h3.t, {rnd('h3.survival', 4)} FROM h3 JOIN top6 ON h3.origin = top6.origin) u""",
    _KM + ",\ntop6 AS (SELECT DISTINCT origin FROM h3 ORDER BY origin LIMIT 6)"))
def q_chart_km_top6(wh: Warehouse) -> DataFrame:
    """G2 Kaplan-Meier step series of the first six channels."""
    return charts.km_top_channels(wh, 6)


_BOOT = ORACLE["bootstrap_ci"]


@register("chart_bootstrap_error", _BOOT.replace(_CI_SELECT, f"""
SELECT origin, mean_revenue_per_deal, {rnd('mean_revenue_per_deal - boot_ci_lower', 2)} AS err_low,
       {rnd('boot_ci_upper - mean_revenue_per_deal', 2)} AS err_high
FROM ({_CI_SELECT}) b"""))
def q_chart_bootstrap_error(wh: Warehouse) -> DataFrame:
    """G3 bootstrap error-bar frame."""
    return charts.bootstrap_error_bars(wh)


# ---------------------------------------------------------------- primitive operators
@register("op_left_on_predicate", O.q("""
SELECT s.seller_key, s.seller_id, CAST(COUNT(i.order_item_key) AS BIGINT) AS n_items,
       COALESCE(CAST(SUM(i.price) AS DOUBLE), CAST(0.0 AS DOUBLE)) AS revenue
FROM dim_seller s LEFT JOIN fact_order_item i ON s.seller_key = i.seller_key AND i.days_after_won >= 0
GROUP BY s.seller_key, s.seller_id"""))
def q_op_left_on_predicate(wh: Warehouse) -> DataFrame:
    """J4 left join with a predicate in the ON clause."""
    return P.left_on_predicate(wh)


@register("op_or_join", O.q("""
SELECT s.seller_id, f.mql_id FROM dim_seller s JOIN fact_lead f ON s.seller_key = f.seller_key OR s.seller_id = f.mql_id"""))
def q_op_or_join(wh: Warehouse) -> DataFrame:
    """J5 disjunctive join as two equi-joins."""
    return P.or_join_pairs(wh)


@register("op_semi", O.q("""
SELECT s.seller_key, s.seller_id FROM dim_seller s
WHERE EXISTS (SELECT 1 FROM fact_order_item i WHERE i.seller_key = s.seller_key AND i.days_after_won >= 0)"""))
def q_op_semi(wh: Warehouse) -> DataFrame:
    """J7 semi join."""
    return P.sellers_with_sales(wh)


@register("op_anti", O.q("""
SELECT s.seller_key, s.seller_id FROM dim_seller s
WHERE NOT EXISTS (SELECT 1 FROM fact_order_item i WHERE i.seller_key = s.seller_key AND i.days_after_won >= 0)"""))
def q_op_anti(wh: Warehouse) -> DataFrame:
    """J8 anti join."""
    return P.sellers_without_sales(wh)


@register("op_default_lookup", O.q(f"SELECT lead_origin, {_cac_sql('lead_origin')} AS est_cac FROM cm", CHANNEL_MATRIX_CTE))
def q_op_default_lookup(wh: Warehouse) -> DataFrame:
    """J9 constant-table lookup with default."""
    return P.default_lookup(wh)


@register("op_count_distinct", O.q("""
SELECT order_status, COUNT(DISTINCT order_id) AS orders, COUNT(DISTINCT seller_key) AS sellers,
       COUNT(DISTINCT customer_key) AS customers FROM fact_order_item GROUP BY order_status"""))
def q_op_count_distinct(wh: Warehouse) -> DataFrame:
    """A2 COUNT(DISTINCT)."""
    return P.count_distinct(wh)


@register("op_interpolated_pct", O.q(f"""
SELECT o.origin_name AS lead_origin, {rnd('quantile_cont(f.days_to_close, 0.5)', 6)} AS median_days,
       {rnd('quantile_cont(f.days_to_close, 0.75)', 6)} AS p75_days
FROM fact_lead f JOIN dim_origin o ON f.origin_key = o.origin_key WHERE f.is_won = 1 GROUP BY o.origin_name"""))
def q_op_interpolated_pct(wh: Warehouse) -> DataFrame:
    """A9 interpolated percentiles."""
    return P.interpolated_pct(wh)


@register("op_stddev", O.q(f"""
SELECT s.segment_name, {rnd('stddev_samp(f.days_to_close)', 6)} AS sd_days
FROM fact_lead f JOIN dim_segment s ON f.segment_key = s.segment_key WHERE f.is_won = 1 GROUP BY s.segment_name"""))
def q_op_stddev(wh: Warehouse) -> DataFrame:
    """A10 sample standard deviation."""
    return P.stddev(wh)


@register("op_benchmark_all", O.q(f"""
SELECT lead_origin, {rnd('conv', 6)} AS conversion_rate, {rnd('ov', 6)} AS overall_conversion_rate,
       {rnd('conv - ov', 6)} AS vs_overall
FROM (SELECT lead_origin, CAST(won AS DOUBLE) / CAST(mqls AS DOUBLE) AS conv,
             CAST(SUM(won) OVER () AS DOUBLE) / CAST(SUM(mqls) OVER () AS DOUBLE) AS ov
      FROM (SELECT o.origin_name AS lead_origin, COUNT(*) AS mqls, SUM(f.is_won) AS won
            FROM fact_lead f JOIN dim_origin o ON f.origin_key = o.origin_key GROUP BY o.origin_name) c) t"""))
def q_op_benchmark_all(wh: Warehouse) -> DataFrame:
    """A15 benchmark ignoring the channel filter."""
    return P.benchmark_all(wh)


@register("op_running_sum", O.q("""
SELECT lead_origin, year_month, mqls,
       SUM(mqls) OVER (PARTITION BY lead_origin ORDER BY year_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_mqls
FROM (SELECT o.origin_name AS lead_origin, CAST(floor(f.date_key_first_contact / 100) AS INTEGER) AS year_month,
             COUNT(*) AS mqls FROM fact_lead f JOIN dim_origin o ON f.origin_key = o.origin_key GROUP BY 1, 2) m"""))
def q_op_running_sum(wh: Warehouse) -> DataFrame:
    """N6 running sum."""
    return P.running_sum(wh)


@register("op_dense_rank", O.q("""
SELECT lead_origin, mqls, CAST(DENSE_RANK() OVER (ORDER BY mqls DESC) AS INTEGER) AS volume_rank
FROM (SELECT o.origin_name AS lead_origin, COUNT(*) AS mqls FROM fact_lead f
      JOIN dim_origin o ON f.origin_key = o.origin_key GROUP BY o.origin_name) c"""))
def q_op_dense_rank(wh: Warehouse) -> DataFrame:
    """N4 dense rank."""
    return P.dense_rank(wh)


@register("op_topk", O.q("""SELECT lead_origin, total_post_signing_revenue FROM cm
ORDER BY total_post_signing_revenue DESC, lead_origin LIMIT 3""", CHANNEL_MATRIX_CTE))
def q_op_topk(wh: Warehouse) -> DataFrame:
    """O3/O4 top-k report."""
    return P.top_k(wh, 3)


@register("op_set_difference", O.q("""
SELECT seller_key FROM fact_lead WHERE seller_key IS NOT NULL
EXCEPT SELECT seller_key FROM fact_order_item WHERE days_after_won >= 0"""))
def q_op_set_difference(wh: Warehouse) -> DataFrame:
    """U1 set difference."""
    return P.set_difference(wh)


@register("op_set_intersection", O.q("""
SELECT seller_id FROM raw_deals WHERE seller_id IS NOT NULL INTERSECT SELECT seller_id FROM raw_items"""))
def q_op_set_intersection(wh: Warehouse) -> DataFrame:
    """U1 set intersection."""
    return P.set_intersection(wh)


@register("op_union_member", O.q("""
SELECT DISTINCT segment_name FROM (SELECT lower(trim(coalesce(business_segment, 'unknown'))) AS segment_name FROM raw_deals
                                  UNION ALL SELECT 'unknown') u"""))
def q_op_union_member(wh: Warehouse) -> DataFrame:
    """U2 union with a literal member."""
    return P.union_member(wh)


@register("op_month_bucket", O.q("""
SELECT CAST(floor(days_after_won / 30) AS INTEGER) AS months_since_signing, COUNT(*) AS items
FROM fact_order_item WHERE days_after_won >= 0 GROUP BY 1"""))
def q_op_month_bucket(wh: Warehouse) -> DataFrame:
    """F11 30-day month bucket."""
    return P.month_buckets(wh)


@register("op_day_floor", O.q("SELECT days_after_won, COUNT(*) AS items FROM fact_order_item GROUP BY 1"))
def q_op_day_floor(wh: Warehouse) -> DataFrame:
    """F10 floored day offsets."""
    return P.day_floor_hist(wh)


@register("op_labels", O.q("""
SELECT f.mql_id, substr(f.mql_id, 1, 3) AS short_id,
       list_aggregate(list_transform(string_split(replace(o.origin_name, '_', ' '), ' '),
                      lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ') AS origin_label
FROM fact_lead f JOIN dim_origin o ON f.origin_key = o.origin_key"""))
def q_op_labels(wh: Warehouse) -> DataFrame:
    """F14 label prettify and short id."""
    return P.labels(wh)


# ---------------------------------------------------------------- SQL surface
from .plans import catalog  # noqa: E402


@register("sql_view_channel_matrix", ORACLE["v_channel_matrix"])
def q_sql_view_channel_matrix(wh: Warehouse) -> DataFrame:
    """S3: the flagship read as ``SELECT * FROM vw_powerbi_channel_matrix`` in Spark SQL."""
    return catalog.read_view(wh, "vw_powerbi_channel_matrix")


@register("sql_lead_explorer", ORACLE["lead_explorer"])
def q_sql_lead_explorer(wh: Warehouse) -> DataFrame:
    """The explorer page as a parameterised Spark SQL statement (:lim = 100)."""
    return catalog.explorer(wh.spark, wh, limit=100)


# ---------------------------------------------------------------- sources and sinks
@register("csv_roundtrip", O.q("""
SELECT seller_key, seller_id, lead_type, CAST(declared_monthly_revenue AS DOUBLE) AS declared_monthly_revenue, has_company, city
FROM dim_seller"""))
def q_csv_roundtrip(wh: Warehouse) -> DataFrame:
    """A dimension written as header CSV and read back with its declared schema."""
    table = wh["dim_seller"].select("seller_key", "seller_id", "lead_type",
                                    F.col("declared_monthly_revenue").cast("double").alias("declared_monthly_revenue"),
                                    "has_company", "city")
    folder = scratch_path(wh.spark, "csv", unique_name("dim_seller"))
    write_csv(table, f"{folder}/dim_seller")
    return read_processed(wh.spark, folder, "dim_seller", table.schema)


@register("json_roundtrip", O.q("""
SELECT lead_origin, total_mqls, closed_deals, conversion_rate, activation_rate FROM cm
UNION ALL SELECT 'not finite ' || lead_origin, total_mqls, closed_deals, NULL, NULL FROM cm""", CHANNEL_MATRIX_CTE))
def q_json_roundtrip(wh: Warehouse) -> DataFrame:
    """The channel matrix written as JSON records (non-finite numbers as null) and read back."""
    table = shared_channel_matrix(wh).select("lead_origin", "total_mqls", "closed_deals", "conversion_rate", "activation_rate")
    # each channel once more, with a NaN and an infinite rate
    odd = table.select(F.concat(F.lit("not finite "), "lead_origin").alias("lead_origin"), "total_mqls", "closed_deals",
                       F.lit(float("nan")).alias("conversion_rate"),
                       F.when(F.col("total_mqls") % 2 == 0, float("inf")).otherwise(float("-inf")).alias("activation_rate"))
    table = table.unionByName(odd)
    path = scratch_path(wh.spark, "json", unique_name("matrix"))
    write_json(table, path)
    return wh.spark.read.schema(table.schema).json(path)


@register("corrupt_rejects", O.q("""
SELECT CASE WHEN k % 97 = 0 THEN 'rejected' ELSE 'read' END AS outcome, COUNT(*) AS n, COUNT(DISTINCT order_id) AS orders
FROM (SELECT order_id, CAST(substr(order_id, 2) AS BIGINT) AS k FROM raw_orders) o GROUP BY k % 97 = 0"""))
def q_corrupt_rejects(wh: Warehouse) -> DataFrame:
    """Orders written as raw CSV, every 97th with an unreadable date; rows that do not parse
    are counted as rejects instead of flowing on as nulls."""
    k = F.substring("order_id", 2, 20).cast("long")
    text = F.when(k % 97 == 0, "not a date").otherwise(F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss"))
    nothing = F.lit(None).cast("string")
    schema = RAW_SCHEMAS["orders"]
    given = wh.raw["orders"].select("order_id", "customer_id", "order_status", text.alias("order_purchase_timestamp"))
    given = given.select(*[F.col(f.name) if f.name in given.columns else nothing.alias(f.name)
                           for f in schema.fields if f.name != "_corrupt_record"])
    path = scratch_path(wh.spark, "csv", unique_name("orders"))
    write_csv(given, path)
    rows = read_csv(wh.spark, path, schema)
    parts = outcomes(rows).select("outcome", F.col("key").alias("order_id"))
    return parts.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("order_id").alias("orders"))


@register("op_price_quantiles", O.q(f"""
SELECT order_status, q, {rnd('quantile_cont(CAST(price AS DOUBLE), 0.05)', 6)} AS price FROM fact_order_item, (SELECT CAST(0.05 AS DOUBLE) AS q) t GROUP BY 1, 2
""" + "".join(f"""UNION ALL
SELECT order_status, CAST({q} AS DOUBLE), {rnd(f'quantile_cont(CAST(price AS DOUBLE), {q})', 6)} FROM fact_order_item GROUP BY order_status
""" for q in (0.25, 0.5, 0.75, 0.95))))
def q_price_quantiles(wh: Warehouse) -> DataFrame:
    """A9 interpolated price quantiles per order status, by range refinement."""
    return P.price_quantiles(wh)


@register("op_sketched_orders", O.q("""
SELECT o.origin_name AS lead_origin, COUNT(DISTINCT i.order_id) AS orders, TRUE AS within_error
FROM fact_order_item i JOIN seller_lead s ON s.seller_key = i.seller_key JOIN dim_origin o ON o.origin_key = s.origin_key
WHERE i.days_after_won >= 0 AND i.order_status <> 'canceled' GROUP BY 1"""))
def q_sketched_orders(wh: Warehouse) -> DataFrame:
    """A2 orders per channel from stored (channel, day) sketches, held against the exact count."""
    return P.sketched_orders(wh)


@register("refresh_fact", O.q("""
SELECT 'fact_lead' AS fact, date_key_first_contact // 100 AS year_month, COUNT(*) AS n_rows, CAST(SUM(is_won) AS DOUBLE) AS amount
FROM fact_lead GROUP BY 2
UNION ALL SELECT 'fact_order_item', date_key_purchase // 100, COUNT(*), CAST(SUM(price) AS DOUBLE) FROM fact_order_item GROUP BY 2"""))
def q_refresh_fact(wh: Warehouse) -> DataFrame:
    """S5 both facts published as month-partitioned versions, read back by month."""
    return P.published_facts(wh)


@register("op_or_join_key_arm", O.q("""
SELECT s.seller_id, l.mql_id FROM dim_seller s JOIN fact_lead l USING (seller_key)"""))
def q_or_join_key_arm(wh: Warehouse) -> DataFrame:
    """J5 with the key arm only."""
    return P.or_join_key_arm(wh)
