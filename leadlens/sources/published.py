"""Published tables: full refresh by version, partitioned, swapped atomically.

A refresh writes a new version beside the old ones and then publishes it: one
row is appended to the table's manifest, by one file rename.  Readers take the
newest published version, so a refresh that dies half way leaves a folder that
nobody reads, and a rerun publishes another one.  Files are laid out by
partition value with AQE's rebalancing, which splits a value that holds many
rows and joins values that hold few.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, path string, rows long"


def month_of(date_key: str) -> Column:
    """YYYYMM of a YYYYMMDD key."""
    return F.floor(F.col(date_key) / 100).cast("int")


def publish(df: DataFrame, root: str, partition_by: str) -> int:
    """Writes ``df`` as a new version of the table at ``root`` and publishes it; returns its number."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    seen = Observation("published")
    (df.hint("rebalance", partition_by).observe(seen, F.count(F.lit(1)).alias("rows"))
       .write.partitionBy(partition_by).parquet(path))
    version = (_newest(spark, root) or (0,))[0] + 1
    _announce(spark, root, version, path, int(seen.get["rows"]))
    return version


def _announce(spark: SparkSession, root: str, version: int, path: str, rows: int) -> None:
    (spark.createDataFrame([(version, path, rows)], MANIFEST).coalesce(1)
     .write.mode("append").parquet(f"{root.rstrip('/')}/manifest"))


def _newest(spark: SparkSession, root: str) -> tuple[int, str, int] | None:
    """(version, path, rows) last published; None before the first."""
    try:
        # two writers at once may take one number: the path decides, for every reader alike
        got = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest").orderBy(F.desc("version"), "path").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if got is None else tuple(got)


def published(spark: SparkSession, root: str) -> DataFrame:
    """The newest published version of the table."""
    newest = _newest(spark, root)
    if newest is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    return spark.read.parquet(newest[1])
