"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a shuffle over edges; nothing is collected and a hub's edges may
spread over many tasks.  The number of rounds grows with the logarithm of the
longest chain; a round ends the loop when its edges form stars.

Defined results: an edge with a null end or from a node to itself joins nothing;
repeated and reversed edges count once; an empty edge table gives an empty result;
only the two end columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node reachable; nodes without an edge are left out."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "cc-edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # larger neighbours of u now point to the least node around u
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "cc-large")
        # and the smaller neighbours of u, with u itself, to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = written(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(least.select("u", F.col("m").alias("v")))
                    .filter("u <> v").distinct(), "cc-small")
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(
            e.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        loose = (ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
                 .filter("child > 1 or (child = 1 and root = 1)").limit(1).count())
        if not loose:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
