"""Spark session defaults and the shared folder used to cut lineage.

Materialised tables (the warehouse, dense-key staging) live under the folder
the cluster names in ``spark.checkpoint.dir``.  On a local master with no
such setting we create one under /tmp, which is what tests do; on a cluster
an unset folder is an error, never a machine-local fallback.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import SparkSession

# Initial shuffle partitions on a cluster (before AQE coalescing).
MIN_INITIAL_SHUFFLE_PARTITIONS = 2048
SHUFFLE_PARTITIONS_PER_CORE = 8

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def get_session(master: str | None = None, app_name: str = "leadlens",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    size_shuffles(spark)
    return spark


def size_shuffles(spark: SparkSession) -> None:
    """On a cluster with no partition count of its own, start AQE from many shuffle
    partitions (it coalesces small ones, but cannot split a too-large one), so a
    multi-terabyte shuffle lands in partitions that fit executor memory."""
    if is_local(spark):
        return
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    sc_conf = spark.sparkContext.getConf()
    if sc_conf.contains(key) or sc_conf.contains("spark.sql.shuffle.partitions"):
        return
    spark.conf.set(key, str(max(MIN_INITIAL_SHUFFLE_PARTITIONS,
                                SHUFFLE_PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="leadlens-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh path under the shared folder, unique per application."""
    root = checkpoint_root(spark).rstrip("/")
    app = spark.sparkContext.applicationId or "app"
    return "/".join([root, "leadlens", app, *parts])


def unique_name(*parts: str) -> str:
    h = hashlib.sha1("|".join(parts).encode()).hexdigest()[:12]
    return f"{h}-{uuid.uuid4().hex[:8]}"


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")
