"""Registrations of the audit queries with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .oracle import sql as O
from .oracle.sql import rnd
from .plans import audit
from .plans.warehouse import Warehouse
from .registry import register

# raw input name -> oracle CTE name
RAW_CTE = {"mql": "raw_mql", "closed_deals": "raw_deals", "orders": "raw_orders", "order_items": "raw_items",
           "order_reviews": "raw_reviews", "customers": "raw_customers", "sellers": "raw_sellers",
           "products": "raw_products", "translation": "raw_trans"}
MQL_COLS = ["mql_id", "first_contact_date", "landing_page_id", "origin"]
DEAL_COLS = ["mql_id", "seller_id", "sdr_id", "sr_id", "won_date", "business_segment", "lead_type",
             "lead_behaviour_profile", "has_company", "has_gtin", "average_stock", "business_type",
             "declared_product_catalog_size", "declared_monthly_revenue"]

_DUPS = """
SELECT 'mql_duplicates' AS metric, CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS value
  FROM (SELECT mql_id, COUNT(*) AS c FROM raw_mql GROUP BY mql_id) a
UNION ALL SELECT 'closed_mql_duplicates', CAST(COALESCE(SUM(c - 1), 0) AS BIGINT)
  FROM (SELECT mql_id, COUNT(*) AS c FROM raw_deals GROUP BY mql_id) b
UNION ALL SELECT 'seller_id_duplicates', CAST(COALESCE(SUM(c - 1), 0) AS BIGINT)
  FROM (SELECT seller_id, COUNT(*) AS c FROM raw_deals GROUP BY seller_id) d"""
_DATES = """SELECT 'date_sanity_violations' AS metric,
  CAST(COUNT(CASE WHEN d.won_date < m.first_contact_date THEN 1 END) AS BIGINT) AS value
  FROM raw_mql m JOIN raw_deals d ON m.mql_id = d.mql_id"""
_ORPHANS = """SELECT 'orphan_closed_mqls' AS metric, CAST(COUNT(*) AS BIGINT) AS value
  FROM (SELECT DISTINCT mql_id FROM raw_deals d
        WHERE NOT EXISTS (SELECT 1 FROM raw_mql m WHERE m.mql_id = d.mql_id)) t"""
_REJECTS = """
SELECT 'no_order' AS reason, 'order_items' AS table_name, CAST(COUNT(*) AS BIGINT) AS violations
  FROM raw_items i WHERE NOT EXISTS (SELECT 1 FROM raw_orders o WHERE o.order_id = i.order_id)
UNION ALL SELECT 'unmapped_seller', 'order_items', CAST(COUNT(*) AS BIGINT)
  FROM raw_items i JOIN raw_orders o ON i.order_id = o.order_id
  WHERE NOT EXISTS (SELECT 1 FROM dim_seller s WHERE s.seller_id = i.seller_id)
UNION ALL SELECT 'unmapped_product', 'order_items', CAST(COUNT(*) AS BIGINT)
  FROM raw_items i JOIN raw_orders o ON i.order_id = o.order_id
  WHERE EXISTS (SELECT 1 FROM dim_seller s WHERE s.seller_id = i.seller_id)
    AND NOT EXISTS (SELECT 1 FROM dim_product p WHERE p.product_id = i.product_id)
UNION ALL SELECT 'unmapped_customer', 'order_items', CAST(COUNT(*) AS BIGINT)
  FROM raw_items i JOIN raw_orders o ON i.order_id = o.order_id
  WHERE EXISTS (SELECT 1 FROM dim_seller s WHERE s.seller_id = i.seller_id)
    AND EXISTS (SELECT 1 FROM dim_product p WHERE p.product_id = i.product_id)
    AND NOT EXISTS (SELECT 1 FROM dim_customer c WHERE c.customer_id = o.customer_id)"""


@register("audit_totals", O.q("""SELECT 'total_mqls' AS metric, CAST(COUNT(*) AS BIGINT) AS value FROM raw_mql
UNION ALL SELECT 'total_closed_deals', CAST(COUNT(*) AS BIGINT) FROM raw_deals"""))
def q_audit_totals(wh: Warehouse) -> DataFrame:
    """Q1 input row totals."""
    return audit.audit_totals(wh)


@register("audit_dups", O.q(_DUPS))
def q_audit_dups(wh: Warehouse) -> DataFrame:
    """Q1/A12 duplicate keys."""
    return audit.audit_dups(wh)


def _nulls_sql() -> str:
    parts = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS value FROM {cte}"
             for t, cte, cols in (("mql", "raw_mql", MQL_COLS), ("closed_deals", "raw_deals", DEAL_COLS))
             for c in cols]
    return O.q("\nUNION ALL ".join(parts))


@register("audit_nulls", _nulls_sql())
def q_audit_nulls(wh: Warehouse) -> DataFrame:
    """Q2/A11 NULL count per input column."""
    return audit.audit_nulls(wh)


@register("audit_date_sanity", O.q(_DATES))
def q_audit_date_sanity(wh: Warehouse) -> DataFrame:
    """Q3 deals won before first contact."""
    return audit.audit_date_sanity(wh)


@register("audit_orphans", O.q(_ORPHANS))
def q_audit_orphans(wh: Warehouse) -> DataFrame:
    """Q4 deals without a lead."""
    return audit.audit_orphans(wh)


@register("audit_activation", O.q(f"""
SELECT CAST(COUNT(*) AS BIGINT) AS closed_sellers_count, CAST(COUNT(s.seller_id) AS BIGINT) AS closed_sellers_with_orders,
       CASE WHEN COUNT(*) > 0 THEN {rnd("COUNT(s.seller_id) / COUNT(*) * 100", 2)} ELSE CAST(0.0 AS DOUBLE) END AS activation_rate_pct
FROM (SELECT DISTINCT seller_id FROM raw_deals WHERE seller_id IS NOT NULL) c
LEFT JOIN (SELECT DISTINCT seller_id FROM raw_items) s ON c.seller_id = s.seller_id"""))
def q_audit_activation(wh: Warehouse) -> DataFrame:
    """Q5 signed sellers with any order item."""
    return audit.audit_activation(wh)


def _constraints_sql() -> str:
    parts = []
    for t, c in audit._PK:
        parts.append(f"SELECT 'unique:{c}' AS check_name, '{t}' AS table_name, "
                     f"CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS violations "
                     f"FROM (SELECT {c}, COUNT(*) AS n FROM {t} GROUP BY {c} HAVING COUNT(*) > 1) x")
    parts.append("SELECT 'unique:order_id,order_item_id', 'fact_order_item', CAST(COUNT(*) AS BIGINT) "
                 "FROM (SELECT order_id, order_item_id FROM fact_order_item GROUP BY 1, 2 HAVING COUNT(*) > 1) x")
    for t, c in audit._NOT_NULL:
        parts.append(f"SELECT 'not_null:{c}', '{t}', CAST(COUNT(*) AS BIGINT) FROM {t} WHERE {c} IS NULL")
    for t, cond in audit._CHECK:
        parts.append(f"SELECT 'check:{cond}', '{t}', CAST(COUNT(*) AS BIGINT) FROM {t} WHERE NOT COALESCE({cond}, TRUE)")
    for t, c, d, k in audit._FK:
        parts.append(f"SELECT 'fk:{c}->{d}', '{t}', CAST(COUNT(*) AS BIGINT) FROM {t} x WHERE x.{c} IS NOT NULL "
                     f"AND NOT EXISTS (SELECT 1 FROM {d} y WHERE y.{k} = x.{c})")
    return O.q("\nUNION ALL ".join(parts))


@register("audit_constraints", _constraints_sql())
def q_audit_constraints(wh: Warehouse) -> DataFrame:
    """Q6 schema constraint violations (PK/UNIQUE, NOT NULL, CHECK, FK)."""
    return audit.audit_constraints(wh)


def _dropped_sql() -> str:
    """Duplicates and orphans per input, counted on the raw tables."""
    twice = [("customers", "raw_customers", "customer_id"), ("products", "raw_products", "product_id"),
             ("sellers", "raw_sellers", "seller_id"), ("translation", "raw_trans", "product_category_name")]
    parts = [f"SELECT 'duplicate' AS reason, '{t}' AS table_name, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {k} FROM {cte}) d) AS violations FROM {cte}"
             for t, cte, k in twice]
    for reason, later, key, parent in (("no_seller", "later_deal_of_seller", "seller_id", "raw_sellers"),
                                       ("no_lead", "later_deal_of_lead", "mql_id", "raw_mql")):
        known = f"EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = d.{key})"
        parts.append(f"SELECT '{reason}', 'closed_deals', COUNT(*) FROM raw_deals d WHERE NOT {known}")
        parts.append(f"SELECT '{later}', 'closed_deals', COUNT(*) - COUNT(DISTINCT d.{key}) FROM raw_deals d WHERE {known}")
    return "\nUNION ALL ".join(parts)


@register("rejects", O.q(f"{_REJECTS}\nUNION ALL {_dropped_sql()}"))
def q_rejects(wh: Warehouse) -> DataFrame:
    """Rows that the build left out, by table and reason."""
    return audit.rejects(wh)


def _stage_sql() -> str:
    parts = [f"SELECT 'raw' AS stage, '{n}' AS table_name, CAST(COUNT(*) AS BIGINT) AS row_count FROM {RAW_CTE[n]}"
             for n in sorted(RAW_CTE)]
    wh_tables = ["dim_customer", "dim_date", "dim_landing_page", "dim_origin", "dim_product", "dim_sdr",
                 "dim_segment", "dim_seller", "dim_sr", "fact_lead", "fact_order_item", "seller_lead"]
    parts += [f"SELECT 'warehouse', '{n}', CAST(COUNT(*) AS BIGINT) FROM {n}" for n in wh_tables]
    return O.q("\nUNION ALL ".join(parts))


@register("stage_counts", _stage_sql())
def q_stage_counts(wh: Warehouse) -> DataFrame:
    """S9 row counts in and out of every stage."""
    return audit.stage_counts(wh)


_LABELS = {"mql_duplicates": "mql_id unique", "closed_mql_duplicates": "deal mql_id unique",
           "seller_id_duplicates": "deal seller_id unique", "date_sanity_violations": "won on/after first contact",
           "orphan_closed_mqls": "every deal has a lead", "fact_lead_minus_leads": "fact_lead rows = leads",
           "items_loaded_minus_input": "items loaded = items in - rejected",
           "rejected_items": "rejected items (reported)"}


@register("audit_status", O.q(f"""
SELECT CASE metric {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items())} END AS check_name,
       metric, value, target, CASE WHEN value = target THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT *, CAST(CASE WHEN metric = 'items_loaded_minus_input'
                          THEN -(SELECT value FROM metrics WHERE metric = 'rejected_items')
                          WHEN metric = 'rejected_items' THEN value ELSE 0 END AS BIGINT) AS target
      FROM metrics) t""", f"""
rej AS ({_REJECTS}),
metrics AS (
  {_DUPS}
  UNION ALL {_DATES}
  UNION ALL {_ORPHANS}
  UNION ALL SELECT 'fact_lead_minus_leads', (SELECT COUNT(*) FROM fact_lead) - (SELECT COUNT(*) FROM raw_mql)
  UNION ALL SELECT 'items_loaded_minus_input', (SELECT COUNT(*) FROM fact_order_item) - (SELECT COUNT(*) FROM raw_items)
  UNION ALL SELECT 'rejected_items', CAST(SUM(violations) AS BIGINT) FROM rej)"""))
def q_audit_status(wh: Warehouse) -> DataFrame:
    """Q7 reconciliation status table."""
    return audit.audit_status(wh)
