"""Dense surrogate keys without a global window.

A global ``row_number()`` puts every row in one task.  Instead:

1. range-partition on the natural key and sort inside each partition;
2. write that once to the shared folder, recording for every row its
   partition id and its position inside the partition (both taken from
   ``monotonically_increasing_id`` in the same stage as the write);
3. count rows per partition from the written files (one tiny row per
   partition reaches the driver, bounded by the partition count, not by
   the data) and turn the counts into prefix offsets;
4. the keyed table is a narrow projection over the written files:
   ``key = offset[partition] + position + 1``; the offsets ride in the plan
   as a small array up to ``MAX_INLINE_OFFSETS`` partitions, beyond that as
   a broadcast (partition, offset) table, so task size never grows with the
   partition count.

Writing first matters: range bounds come from sampling, which is not
repeatable across evaluations, and a lost executor must not renumber rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, unique_name

_POS_BITS = 33
MAX_INLINE_OFFSETS = 4096   # partitions whose offsets may ride inside the plan
_PID = "_dk_pid"
_POS = "_dk_pos"


def _order_cols(order_by: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def dense_key(df: DataFrame, order_by: list[str | Column], key: str,
              name: str = "table", tiebreak: list[str | Column] | None = None,
              ordered: bool = True, stage_input: bool = False) -> tuple[DataFrame, int]:
    """Return (``df`` plus ``key`` (LONG) numbering rows 1..n, n).

    ``ordered``: keys follow ``order_by`` (range partitioning + local sort);
    ``tiebreak`` columns only fix the order inside ties.  Unordered keys
    number rows where they already are: no shuffle at all, still dense,
    unique and fixed once written - the choice for a fact whose natural key
    has ties.  ``stage_input`` writes ``df`` first, so the range sampler
    scans files instead of re-running an expensive upstream plan.
    """
    spark: SparkSession = df.sparkSession
    order = _order_cols(order_by)
    within = order + _order_cols(tiebreak or [])
    staged_path = scratch_path(spark, "keys", unique_name(name, key))
    if stage_input and ordered:
        df.write.mode("overwrite").parquet(staged_path + "-in")
        df = spark.read.parquet(staged_path + "-in")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*within) if ordered else df
    (placed
       .withColumn(_POS, F.monotonically_increasing_id())
       .withColumn(_PID, F.shiftright(_POS, _POS_BITS).cast("int"))
       .withColumn(_POS, F.col(_POS).bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
       .write.mode("overwrite").parquet(staged_path))
    staged = spark.read.parquet(staged_path)
    counts = {r[0]: r[1] for r in staged.groupBy(_PID).agg(F.max(_POS) + 1).collect()}
    if not counts:
        return staged.drop(_PID, _POS).withColumn(key, F.lit(None).cast("long")), 0
    n_parts = max(counts) + 1
    sizes = [counts.get(i, 0) for i in range(n_parts)]
    offsets = [0, *accumulate(sizes)][:-1]
    if n_parts <= MAX_INLINE_OFFSETS:
        # few partitions: the offsets travel inside the plan as one small array
        offset_arr = F.array(*[F.lit(o).cast("long") for o in offsets])
        keyed = staged.withColumn(key, F.element_at(offset_arr, F.col(_PID) + 1) + F.col(_POS) + 1)
    else:
        # many partitions: one (partition, offset) row each, broadcast once per
        # executor instead of serialised into every task
        off = spark.createDataFrame(list(enumerate(offsets)), f"{_PID} int, _dk_off long")
        keyed = (staged.join(F.broadcast(off), _PID)
                 .withColumn(key, F.col("_dk_off") + F.col(_POS) + 1).drop("_dk_off"))
    return keyed.drop(_PID, _POS), offsets[-1] + sizes[-1]


def member_row(spark: SparkSession, key: str, label: str, key_value: int, label_value: str) -> DataFrame:
    """One (key, label) row in a single partition, to append to a dimension."""
    return spark.range(0, 1, 1, 1).select(F.lit(key_value).cast("long").alias(key),
                                          F.lit(label_value).cast("string").alias(label))


def dense_keys_by_group(df: DataFrame, group: str, label: str, name: str = "lookup",
                        probe: str | None = None) -> tuple[DataFrame, dict[str, tuple[int, int, int | None]]]:
    """Dense keys 1..n_g per group in one pass (several small lookup dimensions at once).

    ``df`` holds (group, label) pairs; returns (df + ``_key`` per group,
    {group: (rows, first_key, key of label ``probe`` or None)}).  One tiny
    row per group reaches the driver.
    """
    keyed, _ = dense_key(df.select(group, label).distinct(), [group, label], "_gk", name=name)
    hit = F.min(F.when(F.col(label) == F.lit(probe), F.col("_gk"))) if probe is not None else F.lit(None)
    rows = keyed.groupBy(group).agg(F.count(F.lit(1)), F.min("_gk"), hit).collect()
    stats = {r[0]: (r[1], r[2], None if r[3] is None else r[3] - r[2] + 1) for r in rows}
    first = F.create_map(*[x for g, (_, k0, _) in stats.items() for x in (F.lit(g), F.lit(k0))])
    out = keyed.withColumn("_key", F.col("_gk") - F.element_at(first, F.col(group)) + 1).drop("_gk")
    return out, stats


def running_offsets(df: DataFrame, order_by: str, weight: str, out: str, name: str = "offsets") -> tuple[DataFrame, int]:
    """(``order_by``, ``out``): the sum of ``weight`` over all smaller keys, and the total.

    ``df`` holds one row per key.  As in ``dense_key``, rows are range-partitioned,
    sorted and written with their place; the running sum runs inside a partition
    and starts from the totals of the partitions before it (one number each).
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, "keys", unique_name(name, out))
    (df.select(order_by, weight).repartitionByRange(order_by).sortWithinPartitions(order_by)
       .withColumn(_POS, F.monotonically_increasing_id())
       .withColumn(_PID, F.shiftright(_POS, _POS_BITS).cast("int"))
       .write.mode("overwrite").parquet(path))
    staged = spark.read.parquet(path)
    totals = {r[0]: int(r[1]) for r in staged.groupBy(_PID).agg(F.sum(weight)).collect()}
    starts = dict(zip(sorted(totals), [0, *accumulate(totals[p] for p in sorted(totals))]))
    off = spark.createDataFrame(list(starts.items()), f"{_PID} int, _dk_before long")
    inside = Window.partitionBy(_PID).orderBy(_POS).rowsBetween(Window.unboundedPreceding, -1)
    got = (staged.withColumn(out, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
           .join(F.broadcast(off), _PID))
    return got.select(order_by, (F.col(out) + F.col("_dk_before")).cast("long").alias(out)), sum(totals.values())
