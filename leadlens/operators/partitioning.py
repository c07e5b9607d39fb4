"""Parallelism before row-multiplying work.

An input stored as fewer splits than the cluster has cores (a one-file
table, a small derived table) runs its map side in that many tasks.  That
matters when the next step multiplies rows (bootstrap replicates, a join
fanning out): ``spread`` round-robins such an input over every core first.
An input that already has enough partitions - any large table - is left
untouched, so this never adds a shuffle at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
