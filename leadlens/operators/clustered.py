"""Tables clustered by a key: bucketed once, joined and grouped without a shuffle.

Two tables bucketed alike on a key join on it, and a table groups by it (and by
any further columns), without an Exchange.  The number of buckets follows the
input's bytes, so a bucket stays a task's worth of work at any size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

BUCKET_BYTES = 256 << 20     # of input files behind one bucket, at most
SMALL_BUCKET_BYTES = 4 << 20  # a small input gets no more buckets than this, or the cluster's cores, calls for
HASH_SIDE_BYTES = 16 << 20   # of input files behind one partition of a hashed side, at most
SHIPPED_BYTES = 10 << 20     # up to here Spark's own choice of a join is left alone


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads (statistics of its leaves; nothing is run)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def bucket_count(*inputs: DataFrame) -> int:
    """As many as the session's shuffles have partitions; fewer for a small input (a bucket is a task of every
    later scan), more if a bucket would exceed ``BUCKET_BYTES``."""
    spark = inputs[0].sparkSession
    size = max(input_bytes(d) for d in inputs)
    usual = shuffle_count(spark)
    worth = max(spark.sparkContext.defaultParallelism, -(-size // SMALL_BUCKET_BYTES))
    return max(min(usual, worth), -(-size // BUCKET_BYTES))


def hash_side(df: DataFrame, partitions: int) -> DataFrame:
    """``df`` as the side of a join that is hashed, so neither side is sorted: only if the files behind each of
    ``partitions`` are few (a hash table does not spill), and not if Spark would rather ship ``df`` whole."""
    return df.hint("shuffle_hash") if SHIPPED_BYTES < input_bytes(df) <= partitions * HASH_SIDE_BYTES else df


def shuffle_count(spark: SparkSession) -> int:
    """Partitions that the session's shuffles start from."""
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
               or spark.conf.get("spark.sql.shuffle.partitions"))


def write_clustered(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` written as a table bucketed by ``key``, and read back.  The repartition is planned away if the rows lie
    that way already.  Buckets are not sorted: scans make no use of it, and the writer's sort by (bucket, key) would
    hash the key again in every comparison."""
    spark: SparkSession = df.sparkSession
    name = "leadlens_" + hashlib.sha1(path.encode()).hexdigest()[:20]
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
       .bucketBy(buckets, key).option("path", path).saveAsTable(name))
    return spark.table(name)
