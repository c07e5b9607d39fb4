"""One warehouse per (Spark application, input folder), built on first use."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession

from ..sources.testdata import raw_tables
from .warehouse import Warehouse, build_warehouse

_LOCK = threading.Lock()
_CACHE: dict[tuple, Warehouse] = {}


def warehouse_for(spark: SparkSession, sf_dir: str,
                  date_range: tuple[str, str] | None = None) -> Warehouse:
    """``date_range``: the calendar's first and last day; by default those of the input dates."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), date_range)
    with _LOCK:
        wh = _CACHE.get(key)
        if wh is None:
            # Driver tables are parquet already: read in place, never copied.
            wh = build_warehouse(spark, raw_tables(spark, sf_dir), date_range, land=False)
            _CACHE[key] = wh
        return wh
