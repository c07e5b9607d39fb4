"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import nan_to_null


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet", count_rows: bool = False) -> int | None:
    """Full refresh; rerunning replaces the table instead of appending twice.

    ``count_rows`` (S9): the rows written, observed during the write itself
    (no second pass over the table).
    """
    obs = None
    if count_rows:
        obs = Observation("rows_written")
        df = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)
    return int(obs.get["rows"]) if obs is not None else None


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV export."""
    df.write.mode("overwrite").option("header", True).csv(path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN / +-Infinity -> NULL in every floating column, ready for JSON."""
    return df.select(*[
        nan_to_null(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    """JSON records (one object per line) with non-finite numbers nulled."""
    json_safe(df).write.mode("overwrite").json(path)


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row as a column, built on the executors."""
    return json_safe(df).select(F.to_json(F.struct(*df.columns)).alias("record"))
