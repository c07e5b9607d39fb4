"""Raw CSV inputs with fixed, declared schemas.

No schema inference: every file is read with its StructType, header row,
PERMISSIVE mode and a ``_corrupt_record`` column for rows that do not parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, TS, I, D = T.StringType(), T.TimestampNTZType(), T.IntegerType(), T.DoubleType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields]
                        + [T.StructField("_corrupt_record", S, True)])


RAW_SCHEMAS: dict[str, T.StructType] = {
    "mql": _schema(("mql_id", S), ("first_contact_date", TS), ("landing_page_id", S), ("origin", S)),
    "closed_deals": _schema(
        ("mql_id", S), ("seller_id", S), ("sdr_id", S), ("sr_id", S), ("won_date", TS),
        ("business_segment", S), ("lead_type", S), ("lead_behaviour_profile", S),
        ("has_company", I), ("has_gtin", I), ("average_stock", S), ("business_type", S),
        ("declared_product_catalog_size", D), ("declared_monthly_revenue", T.DecimalType(12, 2))),
    "orders": _schema(
        ("order_id", S), ("customer_id", S), ("order_status", S), ("order_purchase_timestamp", TS),
        ("order_approved_at", TS), ("order_delivered_carrier_date", TS),
        ("order_delivered_customer_date", TS), ("order_estimated_delivery_date", TS)),
    "order_items": _schema(
        ("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
        ("shipping_limit_date", TS), ("price", T.DecimalType(10, 2)),
        ("freight_value", T.DecimalType(10, 2))),
    "order_payments": _schema(
        ("order_id", S), ("payment_sequential", I), ("payment_type", S),
        ("payment_installments", I), ("payment_value", T.DecimalType(10, 2))),
    "order_reviews": _schema(
        ("review_id", S), ("order_id", S), ("review_score", I), ("review_comment_title", S),
        ("review_comment_message", S), ("review_creation_date", TS), ("review_answer_timestamp", TS)),
    "customers": _schema(
        ("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", I),
        ("customer_city", S), ("customer_state", S)),
    "sellers": _schema(
        ("seller_id", S), ("seller_zip_code_prefix", I), ("seller_city", S), ("seller_state", S)),
    "products": _schema(
        ("product_id", S), ("product_category_name", S), ("product_name_lenght", I),
        ("product_description_lenght", I), ("product_photos_qty", I), ("product_weight_g", D),
        ("product_length_cm", I), ("product_height_cm", I), ("product_width_cm", I)),
    "translation": _schema(("product_category_name", S), ("product_category_name_english", S)),
}

# The raw file names of the public dataset layout.
RAW_FILES = {
    "mql": "olist_marketing_qualified_leads_dataset.csv",
    "closed_deals": "olist_closed_deals_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "customers": "olist_customers_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "products": "olist_products_dataset.csv",
    "translation": "product_category_name_translation.csv",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema; unparsable rows keep ``_corrupt_record``."""
    return (spark.read.schema(schema)
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("timestampNTZFormat", "yyyy-MM-dd[ HH:mm:ss]")
            .csv(path))


def read_raw(spark: SparkSession, raw_dir: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The ten raw datasets (or a subset) from a directory of CSVs; the rows that do not
    parse are left to ``read_rejects``."""
    out = {}
    for name in tables or list(RAW_FILES):
        df = read_csv(spark, f"{raw_dir.rstrip('/')}/{RAW_FILES[name]}", RAW_SCHEMAS[name])
        out[name] = parsed_rows(df)
    return out


def _all_parsed(df: DataFrame) -> Column:
    """True for every row, but names all columns: a row is corrupt whichever columns a query
    needs, and the reader only parses the columns that are named."""
    return F.length(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns if c != "_corrupt_record"])) >= 0


def parsed_rows(df: DataFrame) -> DataFrame:
    """Rows of a raw CSV that parse, without the corrupt-record column."""
    return df.filter(F.col("_corrupt_record").isNull() & _all_parsed(df)).drop("_corrupt_record")


def rejected_rows(df: DataFrame) -> DataFrame:
    """Key (first column, where it was readable) and text of each raw CSV row that does not parse."""
    return (df.filter(F.col("_corrupt_record").isNotNull() & _all_parsed(df))
            .select(F.col(df.columns[0]).cast("string").alias("key"), F.col("_corrupt_record").alias("record")))


def outcomes(df: DataFrame) -> DataFrame:
    """Every raw CSV row as read or rejected, with its key (first column, where it was readable), in one pass."""
    return df.filter(_all_parsed(df)).select(
        F.when(F.col("_corrupt_record").isNull(), "read").otherwise("rejected").alias("outcome"),
        F.col(df.columns[0]).cast("string").alias("key"))


def read_rejects(spark: SparkSession, raw_dir: str, tables: list[str] | None = None) -> DataFrame:
    """(table, key, record) of every row that does not parse, over all raw files."""
    out = None
    for name in tables or list(RAW_FILES):
        df = read_csv(spark, f"{raw_dir.rstrip('/')}/{RAW_FILES[name]}", RAW_SCHEMAS[name])
        rows = rejected_rows(df).select(F.lit(name).alias("table"), "key", "record")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_processed(spark: SparkSession, processed_dir: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A processed fact or dimension table: parquet, or header CSV with its declared schema."""
    path = f"{processed_dir.rstrip('/')}/{name}"
    if schema is not None:
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)
