"""Registered queries (name -> (spark, sf_dir) -> DataFrame) and their DuckDB twins.

Every query reads the driver's whole tables through the warehouse build;
none runs on made-up input.  Output columns are aliased identically on the
Spark and SQL sides; dates and timestamps are rendered as text and money as
DOUBLE so both engines hand back the same Python values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .oracle import sql as O
from .plans.context import warehouse_for
from .plans.warehouse import Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Warehouse], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(warehouse_for(spark, sf_dir))
        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def portable(df: DataFrame) -> DataFrame:
    """Dates/timestamps as text, decimals as DOUBLE (same Python values in both engines)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _table_sql(name: str, columns: list[str], casts: dict[str, str] | None = None) -> str:
    casts = casts or {}
    sel = ", ".join(f"CAST({c} AS {casts[c]}) AS {c}" if c in casts else c for c in columns)
    return O.q(f"SELECT {sel} FROM {name}")


# ---------------------------------------------------------------- warehouse
_WH_TABLES = {
    "dim_origin": (["origin_key", "origin_name"], {}),
    "dim_landing_page": (["landing_page_key", "landing_page_id"], {}),
    "dim_segment": (["segment_key", "segment_name"], {}),
    "dim_sdr": (["sdr_key", "sdr_id"], {}),
    "dim_sr": (["sr_key", "sr_id"], {}),
    "dim_date": (["date_key", "full_date", "year", "quarter", "month", "month_name", "day_of_month",
                  "day_of_week", "week_of_year"], {"full_date": "VARCHAR"}),
    "dim_customer": (["customer_key", "customer_id", "customer_unique_id", "city", "state"], {}),
    "dim_product": (["product_key", "product_id", "category_name_pt", "category_name_en", "weight_g"], {}),
    "dim_seller": (["seller_key", "seller_id", "won_date", "lead_type", "lead_behaviour_profile",
                    "business_type", "declared_monthly_revenue", "declared_product_catalog_size",
                    "average_stock", "has_company", "has_gtin", "city", "state"],
                   {"won_date": "VARCHAR", "declared_monthly_revenue": "DOUBLE"}),
    "fact_lead": (["lead_key", "mql_id", "date_key_first_contact", "origin_key", "landing_page_key",
                   "is_won", "date_key_won", "days_to_close", "seller_key", "segment_key", "sdr_key",
                   "sr_key"], {}),
    "fact_order_item": (["order_item_key", "order_id", "order_item_id", "date_key_purchase", "seller_key", "product_key",
                         "customer_key", "price", "freight_value", "order_status", "review_score",
                         "days_after_won"], {"price": "DOUBLE", "freight_value": "DOUBLE"}),
    "seller_lead": (["seller_key", "seller_id", "lead_key", "mql_id", "origin_key", "segment_key",
                     "is_won"], {}),
}


def _register_table(name: str, cols: list[str], casts: dict[str, str]) -> None:
    def fn(wh: Warehouse) -> DataFrame:
        return portable(wh[name].select(*cols))
    fn.__doc__ = f"Warehouse table {name}."
    register(name, _table_sql(name, cols, casts))(fn)


for _n, (_c, _k) in _WH_TABLES.items():
    _register_table(_n, _c, _k)


# ---------------------------------------------------------------- analyses
from . import queries_analytics  # noqa: E402,F401  (registers the rest)
from . import queries_audit  # noqa: E402,F401
from . import queries_stats  # noqa: E402,F401
from . import queries_measures  # noqa: E402,F401
from . import queries_ops  # noqa: E402,F401
