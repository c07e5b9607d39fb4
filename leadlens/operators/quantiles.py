"""Exact interpolated quantiles over unbounded domains by range refinement.

A quantile needs the values of two ranks.  Every rank starts with its group's
whole range; a round counts the values of the range in at most ``BINS`` equal
bins, finds the bin that holds the rank, and goes on inside it, until a bin is
one value.  A round is one scan with a map-side combined count, and the state is
groups x ranks x ``BINS`` rows, however many values there are: a sort or a map
of all distinct values is never built.  64-bit values take seven rounds at most.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, unique_name
from .joins import broadcast_if

BINS = 1024


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, "quantiles", unique_name(name))
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _on(by: list[str], left: str, right: str) -> Column:
    """Equal groups; a NULL is a group like any other."""
    return reduce(and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by])


def interpolated_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], bins: int = BINS) -> DataFrame:
    """(by, q, value): for each group and q the value at q * (n - 1), linear between its two
    neighbours, of the non-null LONG column ``value`` (within +-2^61); a group without values has no row."""
    if not by:
        return interpolated_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, qs, bins).drop("_all")
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("long").alias("_v"))
    at = F.col("n").cast("double") - 1
    ends = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.floor(at * q).cast("long").alias("a"), F.ceil(at * q).cast("long").alias("b"),
                              (at * q - F.floor(at * q)).alias("share")) for q in qs])
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    wanted = _kept(groups.select(*by, "lo", "hi", F.explode(ends).alias("e")).select(*by, "lo", "hi", "e.*"), "wanted")
    # left: how many values of the range lie below the rank
    ranks = _kept(wanted.select(*by, "lo", "hi", F.explode(F.array("a", "b")).alias("rank")).distinct()
                  .withColumn("left", F.col("rank")), "ranks")
    while n_open := ranks.filter("lo < hi").count():
        open_ = ranks.filter("lo < hi")
        # ranks that are still in one range share its count
        ranges = open_.select(*by, "lo", "hi").distinct().withColumn("width", F.expr(f"(hi - lo) div {bins} + 1"))
        inside = (rows.alias("v").join(broadcast_if(ranges, n_open).alias("r"), _on(by, "v", "r")).filter("_v between lo and hi")
                  .select("r.*", F.expr("(_v - lo) div width").alias("bin")))
        cells = inside.groupBy(*by, "lo", "hi", "width", "bin").agg(F.count(F.lit(1)).alias("c"))
        cells = cells.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "lo", "hi").orderBy("bin")))
        hit = _on(by, "o", "c") & F.expr("o.lo = c.lo and o.hi = c.hi and left < upto and left >= upto - c.c")
        begin = F.expr("c.lo + bin * width")
        found = open_.alias("o").join(cells.alias("c"), hit).select(
            *[F.col(f"o.{c}").alias(c) for c in by], begin.alias("lo"), F.least(begin + F.col("width") - 1, F.col("c.hi")).alias("hi"),
            "rank", F.expr("left - upto + c.c").alias("left"))
        ranks = _kept(found.unionByName(ranks.filter("lo = hi")), "ranks")
    end = lambda place: ranks.select(*by, "rank", "lo").alias(place)
    return (wanted.drop("lo", "hi").alias("w")
            .join(end("x"), _on(by, "w", "x") & (F.col("w.a") == F.col("x.rank")))
            .join(end("y"), _on(by, "w", "y") & (F.col("w.b") == F.col("y.rank")))
            .select(*[F.col(f"w.{c}").alias(c) for c in by], "q",
                    (F.col("x.lo") + F.col("share") * (F.col("y.lo") - F.col("x.lo"))).alias(value)))
