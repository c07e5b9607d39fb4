"""SQL surface over the warehouse.

The warehouse tables and the five BI views become session views, so an
analysis can be written as Spark SQL the way the BI tool and the endpoints
read them (``SELECT * FROM vw_powerbi_channel_matrix``); each view is the
DataFrame plan of its operator, so Catalyst optimises through it.  The data
explorer is a parameterised statement (named parameter ``:lim``), and every
warehouse table can be exported as header CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import write_csv
from . import funnel, revenue
from .warehouse import Warehouse

# Names of the five BI views, in the order they are defined.
VIEWS = {
    "vw_powerbi_funnel_conversion": funnel.funnel_view,
    "vw_powerbi_time_to_close": revenue.lead_time_to_close,
    "vw_powerbi_seller_post_signing": revenue.seller_post_signing,
    "vw_powerbi_cohort_revenue": revenue.cohort_matrix,
    "vw_powerbi_channel_matrix": revenue.channel_matrix,
}

WAREHOUSE_TABLES = ["dim_date", "dim_origin", "dim_landing_page", "dim_seller", "dim_segment", "dim_sdr",
                    "dim_sr", "dim_product", "dim_customer", "fact_lead", "fact_order_item"]

EXPLORER_SQL = """
SELECT lead_key, mql_id, origin_name, landing_page_id, is_won, days_to_close
FROM fact_lead JOIN dim_landing_page USING (landing_page_key) JOIN dim_origin USING (origin_key)
ORDER BY lead_key LIMIT :lim"""


def register_views(wh: Warehouse) -> list[str]:
    """Warehouse tables and BI views as temporary views of this session."""
    names = []
    for name in WAREHOUSE_TABLES:
        wh[name].createOrReplaceTempView(name)
        names.append(name)
    for name, build in VIEWS.items():
        build(wh).createOrReplaceTempView(name)
        names.append(name)
    return names


def read_view(wh: Warehouse, name: str) -> DataFrame:
    """S3: ``SELECT * FROM <view>`` through Spark SQL."""
    register_views(wh)
    return wh.spark.sql(f"SELECT * FROM {name}")


def explorer(spark: SparkSession, wh: Warehouse, limit: int = 100) -> DataFrame:
    """The explorer page as a parameterised statement (bound, never spliced)."""
    register_views(wh)
    return spark.sql(EXPLORER_SQL, args={"lim": int(limit)})


def export_csv(wh: Warehouse, folder: str, tables: list[str] | None = None) -> list[str]:
    """Every warehouse table (all eleven, incl. SDR / SR) as a header-CSV folder."""
    out = []
    for name in tables or WAREHOUSE_TABLES:
        path = f"{folder.rstrip('/')}/{name}"
        write_csv(wh[name], path)
        out.append(path)
    return out
