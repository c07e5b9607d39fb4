"""DuckDB twins of the queries, for the driver's correctness gate.

``PRELUDE`` spells the test-data adapter and the warehouse build as CTEs
over the driver's pre-registered views; each query appends its own body.
Floating results are rounded with ``rnd`` which reproduces Spark's
HALF_UP-on-decimal-text rounding of a DOUBLE.
"""

from __future__ import annotations

from ..sources.testdata import (AVERAGE_STOCK, BEHAVIOUR_PROFILES, BUSINESS_TYPES, CANCELED_STATUS,
                                LEAD_TYPES, UNKNOWN_ORIGIN_SEGMENT,
                                UNTRANSLATED_CATEGORY, WON_PRIORITY, WON_STATUS, pick)


def rnd(expr: str, digits: int) -> str:
    """Spark's round(DOUBLE, d): HALF_UP applied to the shortest decimal text of the
    double (e.g. 7881255.215 -> .22 although its binary value is just below)."""
    text = f"format('{{:.15g}}', CAST(({expr}) AS DOUBLE))"
    return f"CAST(round(CAST({text} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def day_floor(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch({later}) - epoch({earlier})) / 86400) AS INTEGER)"


def date_key(ts: str) -> str:
    return f"CAST(strftime({ts}, '%Y%m%d') AS INTEGER)"


def wilson(k: str, n: str, z: float = 1.96, clamp: bool = False) -> tuple[str, str, str]:
    """Same operation order as ``functions.exprs.wilson``."""
    z2 = dbl(z * z)
    nd = f"CAST({n} AS DOUBLE)"
    p = f"(CAST({k} AS DOUBLE) / {nd})"
    centre = f"({p} + {z2} / (2 * {nd}))"
    half = f"({dbl(z)} * sqrt(({p} * (CAST(1.0 AS DOUBLE) - {p}) + {z2} / (4 * {nd})) / {nd}))"
    denom = f"(CAST(1.0 AS DOUBLE) + {z2} / {nd})"
    lo = f"(({centre} - {half}) / {denom})"
    hi = f"(({centre} + {half}) / {denom})"
    if clamp:
        lo = f"greatest(CAST(0.0 AS DOUBLE), {lo})"
        hi = f"least(CAST(1.0 AS DOUBLE), {hi})"
    guard = lambda e: f"(CASE WHEN {n} IS NULL OR {n} = 0 THEN CAST(0.0 AS DOUBLE) ELSE {e} END)"
    return guard(p), guard(lo), guard(hi)


def _s(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


ADAPTER = f"""
raw_mql AS (
  SELECT 'm' || {_s('c.c_custkey')} AS mql_id, f.first_contact_date,
         'lp' || {_s('c.c_nationkey')} AS landing_page_id,
         CASE WHEN c.c_mktsegment <> '{UNKNOWN_ORIGIN_SEGMENT}' THEN c.c_mktsegment END AS origin
  FROM customer c
  JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_contact_date FROM orders GROUP BY o_custkey) f
    ON c.c_custkey = f.o_custkey),
raw_deals AS (
  SELECT 'm' || {_s('c_custkey')} AS mql_id, 's' || {_s('c_custkey')} AS seller_id,
         'd' || {_s('c_custkey % 12')} AS sdr_id, 'r' || {_s('c_custkey % 15')} AS sr_id,
         w.won_date, 'seg' || {_s('c_nationkey % 13')} AS business_segment,
         {pick(LEAD_TYPES, 'c_custkey')} AS lead_type,
         {pick(BEHAVIOUR_PROFILES, 'c_custkey')} AS lead_behaviour_profile,
         CAST(c_custkey % 2 AS INTEGER) AS has_company,
         CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS has_gtin,
         {pick(AVERAGE_STOCK, 'c_custkey')} AS average_stock,
         {pick(BUSINESS_TYPES, 'c_custkey')} AS business_type,
         CAST(c_custkey % 200 AS INTEGER) AS declared_product_catalog_size,
         CAST(c_acctbal AS DECIMAL(12,2)) AS declared_monthly_revenue
  FROM customer c
  JOIN (SELECT o_custkey, MIN(o_orderdate) + INTERVAL 12 HOUR AS won_date FROM orders
        WHERE o_orderpriority = '{WON_PRIORITY}' AND o_orderstatus = '{WON_STATUS}' GROUP BY o_custkey) w
    ON c.c_custkey = w.o_custkey),
raw_geo AS (
  SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
raw_sellers AS (SELECT 's' || {_s('c_custkey')} AS seller_id, n_name AS seller_city, r_name AS seller_state FROM raw_geo),
raw_customers AS (SELECT 'c' || {_s('c_custkey')} AS customer_id, 'u' || {_s('c_custkey')} AS customer_unique_id,
                         n_name AS customer_city, r_name AS customer_state FROM raw_geo),
raw_orders AS (
  SELECT 'o' || {_s('o_orderkey')} AS order_id, 'c' || {_s('o_custkey')} AS customer_id,
         CASE WHEN o_orderstatus = '{CANCELED_STATUS}' THEN 'canceled' ELSE 'delivered' END AS order_status,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS order_purchase_timestamp
  FROM orders),
raw_items AS (
  SELECT 'o' || {_s('l.l_orderkey')} AS order_id, l.l_linenumber AS order_item_id,
         'p' || {_s('l.l_partkey')} AS product_id, 's' || {_s('o.o_custkey')} AS seller_id,
         CAST(l.l_extendedprice AS DECIMAL(10,2)) AS price,
         CAST(CAST(l.l_extendedprice AS DECIMAL(10,2)) * CAST(l.l_tax AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS freight_value
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
raw_reviews AS (
  SELECT 'o' || {_s('l_orderkey')} AS order_id, CAST(1 + l_quantity % 5 AS INTEGER) AS review_score FROM lineitem),
raw_products AS (
  SELECT 'p' || {_s('p_partkey')} AS product_id, p_type AS product_category_name, p_size AS product_weight_g FROM part),
raw_trans AS (
  SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english
  FROM part WHERE p_type <> '{UNTRANSLATED_CATEGORY}')"""

WAREHOUSE = f"""
dim_origin AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY origin_name) AS BIGINT) AS origin_key, origin_name
  FROM (SELECT DISTINCT lower(trim(coalesce(origin, 'unknown'))) AS origin_name FROM raw_mql)),
dim_landing_page AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY landing_page_id) AS BIGINT) AS landing_page_key, landing_page_id
  FROM (SELECT DISTINCT landing_page_id FROM raw_mql WHERE landing_page_id IS NOT NULL)
  UNION ALL SELECT CAST(0 AS BIGINT), 'unknown'),
dim_sdr AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY sdr_id) AS BIGINT) AS sdr_key, sdr_id
  FROM (SELECT DISTINCT sdr_id FROM raw_deals WHERE sdr_id IS NOT NULL)
  UNION ALL SELECT CAST(0 AS BIGINT), 'unknown'),
dim_sr AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY sr_id) AS BIGINT) AS sr_key, sr_id
  FROM (SELECT DISTINCT sr_id FROM raw_deals WHERE sr_id IS NOT NULL)
  UNION ALL SELECT CAST(0 AS BIGINT), 'unknown'),
seg_found AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY segment_name) AS BIGINT) AS segment_key, segment_name
  FROM (SELECT DISTINCT lower(trim(coalesce(business_segment, 'unknown'))) AS segment_name FROM raw_deals)),
dim_segment AS (
  SELECT * FROM seg_found
  UNION ALL SELECT (SELECT COUNT(*) FROM seg_found) + 1, 'unknown'
  WHERE NOT EXISTS (SELECT 1 FROM seg_found WHERE segment_name = 'unknown')),
dim_date AS (
  SELECT {date_key('d')} AS date_key, CAST(d AS DATE) AS full_date,
         CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
         CAST(month(d) AS INTEGER) AS month, strftime(d, '%B') AS month_name,
         CAST(day(d) AS INTEGER) AS day_of_month, CAST(isodow(d) AS INTEGER) AS day_of_week,
         CAST(weekofyear(d) AS INTEGER) AS week_of_year
  FROM (SELECT unnest(generate_series(date_trunc('day', MIN(x)), date_trunc('day', MAX(x)), INTERVAL 1 DAY)) AS d
        FROM (SELECT first_contact_date AS x FROM raw_mql UNION ALL SELECT won_date FROM raw_deals
              UNION ALL SELECT order_purchase_timestamp FROM raw_orders) all_dates) t),
dim_customer AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY customer_id) AS BIGINT) AS customer_key, customer_id,
         customer_unique_id, customer_city AS city, customer_state AS state
  FROM raw_customers),
dim_product AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY p.product_id) AS BIGINT) AS product_key, p.product_id,
         coalesce(p.product_category_name, 'outros') AS category_name_pt,
         coalesce(t.product_category_name_english, 'other') AS category_name_en,
         coalesce(CAST(p.product_weight_g AS INTEGER), 0) AS weight_g
  FROM raw_products p LEFT JOIN raw_trans t ON p.product_category_name = t.product_category_name),
dim_seller AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY s.seller_id) AS BIGINT) AS seller_key, s.seller_id, d.won_date,
         coalesce(d.lead_type, 'unknown') AS lead_type,
         coalesce(d.lead_behaviour_profile, 'unknown') AS lead_behaviour_profile,
         coalesce(d.business_type, 'unknown') AS business_type,
         coalesce(d.declared_monthly_revenue, CAST(0 AS DECIMAL(12,2))) AS declared_monthly_revenue,
         coalesce(d.declared_product_catalog_size, 0) AS declared_product_catalog_size,
         coalesce(d.average_stock, 'unknown') AS average_stock,
         coalesce(d.has_company, 0) AS has_company, coalesce(d.has_gtin, 0) AS has_gtin,
         s.seller_city AS city, s.seller_state AS state
  FROM raw_sellers s LEFT JOIN raw_deals d ON s.seller_id = d.seller_id),
fact_lead AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY m.mql_id) AS BIGINT) AS lead_key, m.mql_id,
         {date_key('m.first_contact_date')} AS date_key_first_contact,
         o.origin_key,
         coalesce(lp.landing_page_key, 0) AS landing_page_key,
         CASE WHEN d.seller_id IS NOT NULL THEN 1 ELSE 0 END AS is_won,
         {date_key('d.won_date')} AS date_key_won,
         {day_floor('d.won_date', 'm.first_contact_date')} AS days_to_close,
         sel.seller_key,
         coalesce(sg.segment_key, (SELECT segment_key FROM dim_segment WHERE segment_name = 'unknown')) AS segment_key,
         coalesce(sd.sdr_key, 0) AS sdr_key, coalesce(sr.sr_key, 0) AS sr_key
  FROM raw_mql m
  LEFT JOIN raw_deals d ON m.mql_id = d.mql_id
  LEFT JOIN dim_origin o ON lower(trim(coalesce(m.origin, 'unknown'))) = o.origin_name
  LEFT JOIN dim_landing_page lp ON m.landing_page_id = lp.landing_page_id
  LEFT JOIN dim_segment sg ON lower(trim(coalesce(d.business_segment, 'unknown'))) = sg.segment_name
  LEFT JOIN dim_sdr sd ON d.sdr_id = sd.sdr_id
  LEFT JOIN dim_sr sr ON d.sr_id = sr.sr_id
  LEFT JOIN dim_seller sel ON d.seller_id = sel.seller_id),
review_avg AS (SELECT order_id, AVG(review_score) AS review_mean FROM raw_reviews GROUP BY order_id),
item_rows AS (
  SELECT i.order_id, i.order_item_id, {date_key('o.order_purchase_timestamp')} AS date_key_purchase,
         sel.seller_key, p.product_key, c.customer_key, i.price, i.freight_value, o.order_status,
         CAST(round_even(r.review_mean, 0) AS INTEGER) AS review_score,
         {day_floor('o.order_purchase_timestamp', 'sel.won_date')} AS days_after_won
  FROM raw_items i
  JOIN raw_orders o ON i.order_id = o.order_id
  LEFT JOIN review_avg r ON i.order_id = r.order_id
  JOIN dim_seller sel ON i.seller_id = sel.seller_id
  JOIN dim_product p ON i.product_id = p.product_id
  JOIN dim_customer c ON o.customer_id = c.customer_id),
fact_order_item AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY order_id, order_item_id, date_key_purchase, seller_key, product_key, customer_key,
              price, freight_value, order_status, review_score NULLS FIRST, days_after_won NULLS FIRST) AS BIGINT) AS order_item_key, *
  FROM item_rows),
seller_lead AS (
  SELECT sel.seller_key, sel.seller_id, fl.lead_key, fl.mql_id, fl.origin_key, fl.segment_key, fl.is_won
  FROM dim_seller sel JOIN fact_lead fl ON sel.seller_key = fl.seller_key OR sel.seller_id = fl.mql_id)"""

PRELUDE = "WITH" + ADAPTER + "," + WAREHOUSE


def q(body: str, ctes: str = "") -> str:
    """A full statement: prelude CTEs, optional extra CTEs, then the body."""
    extra = ("," + ctes) if ctes.strip() else ""
    return PRELUDE + extra + "\n" + body
