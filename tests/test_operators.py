"""Operator-level fixtures and properties."""

import math

import pytest
from pyspark.sql import functions as F


def test_wilson_bounds_and_zero(spark):
    from leadlens.functions.exprs import wilson
    df = spark.createDataFrame([(0, 0), (0, 10), (5, 10), (10, 10), (83, 836)], "k long, n long")
    p, lo, hi = wilson("k", "n", z=1.96, clamp=True)
    out = df.select("k", "n", p.alias("p"), lo.alias("lo"), hi.alias("hi")).collect()
    for r in out:
        assert 0.0 <= r.lo <= r.p <= r.hi <= 1.0
    assert (out[0].p, out[0].lo, out[0].hi) == (0.0, 0.0, 0.0)
    # textbook value for 5/10 at z = 1.96: (0.2366, 0.7634)
    mid = [r for r in out if r.k == 5][0]
    assert round(mid.lo, 4) == 0.2366 and round(mid.hi, 4) == 0.7634


def test_day_floor_boundaries(spark):
    from leadlens.functions.exprs import day_floor
    df = spark.createDataFrame([("2018-01-11 10:00:00", "2018-01-11 12:00:00"),
                                ("2018-01-11 12:00:00", "2018-01-11 12:00:00"),
                                ("2018-01-12 11:59:59", "2018-01-11 12:00:00"),
                                ("2018-01-12 00:00:01", "2018-01-11 23:00:00")], "a string, b string")
    df = df.select(F.to_timestamp_ntz("a").alias("a"), F.to_timestamp_ntz("b").alias("b"))
    assert [r[0] for r in df.select(day_floor("a", "b")).collect()] == [-1, 0, 0, 0]


def test_nearest_rank_percentiles(spark):
    from leadlens.operators.aggregates import nearest_rank_percentiles
    df = spark.createDataFrame([("a", v) for v in [1, 2, 3, 10]] + [("b", 7)], "g string, v int")
    out = {r.g: r for r in nearest_rank_percentiles(df, ["g"], "v", {"p50": 50, "p90": 90}).collect()}
    # n=4: round(2)=2 -> 2 ; round(3.6)=4 -> 10 ; n=1: round(0.5)=1 -> 7
    assert (out["a"].p50, out["a"].p90) == (2, 10)
    assert (out["b"].p50, out["b"].p90) == (7, 7)


def test_dense_key_many_partitions(spark):
    from leadlens.operators.keys import dense_key
    df = spark.range(0, 5000, 1, 16).select((F.col("id") * 7 % 5000).cast("string").alias("k"))
    keyed, n = dense_key(df, ["k"], "key", name="t")
    got = sorted((r.k, r.key) for r in keyed.collect())
    assert n == 5000
    assert [k for _, k in sorted(got, key=lambda x: x[1])] == list(range(1, 5001))
    assert [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got)


def test_dense_key_broadcast_offsets_match_inline(spark, monkeypatch):
    from leadlens.operators import keys
    df = spark.range(0, 5000, numPartitions=6).select((F.col("id") * 7 % 5003).alias("k"))
    inline, n1 = keys.dense_key(df, ["k"], "key", name="inline")
    monkeypatch.setattr(keys, "MAX_INLINE_OFFSETS", 0)     # force the broadcast form
    joined, n2 = keys.dense_key(df, ["k"], "key", name="joined")
    assert n1 == n2 == 5000
    a = sorted((r.k, r.key) for r in inline.collect())
    b = sorted((r.k, r.key) for r in joined.collect())
    assert a == b and [k for _, k in a] == list(range(1, 5001))


def test_spread_only_when_partitions_are_few(spark):
    from leadlens.operators.partitioning import spread
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, cores * 2)
    assert spread(many) is many                                   # enough splits: untouched
    one = spark.range(0, 1000, 1, 1)
    spread_one = spread(one)
    assert spread_one.rdd.getNumPartitions() == cores
    assert sorted(r.id for r in spread_one.collect()) == list(range(1000))


def test_or_join_matches_cartesian_definition(spark):
    from leadlens.operators.joins import or_join
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, s string")
    right = spark.createDataFrame([(1, "x"), (5, "a"), (1, "a"), (None, "c")], "k long, s string")
    got = or_join(left, right, ("k", "k"), ("s", "s"),
                  select=[F.col("l.s").alias("ls"), F.col("r.s").alias("rs"), F.col("r.k").alias("rk")])
    want = sorted((ls, rs, rk) for lk, ls in [(1, "a"), (2, "b"), (None, "c")]
                  for rk, rs in [(1, "x"), (5, "a"), (1, "a"), (None, "c")]
                  if (lk is not None and rk is not None and lk == rk) or ls == rs)
    assert sorted(tuple(r) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_chi2_sf_known_values(spark):
    from leadlens.functions.stats import chi2_sf_col
    known = [(3.841458820694124, 1, 0.05), (9.487729036781154, 4, 0.05), (0.0, 3, 1.0), (5000.0, 3, 0.0), (124.342113, 100, 0.05),
             (None, 3, None), (1.0, 0, None), (11.070497693516351, 5, 0.05)]
    df = spark.createDataFrame(known, "x double, dof int, p double").select("p", chi2_sf_col(F.col("x"), F.col("dof")).alias("q"))
    for r in df.collect():
        assert r.q is None if r.p is None else abs(r.q - r.p) < 1e-8



def test_json_safe_nulls_non_finite(spark):
    from leadlens.sources.sinks import json_records
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    assert [r[0] for r in json_records(df).collect()] == ['{"x":1.0}', "{}", "{}"]


def test_date_dim(spark):
    from leadlens.sources.dates import date_dim
    d = date_dim(spark, "2017-01-01", "2019-12-31")
    assert d.count() == 1095
    r = d.filter(F.col("date_key") == 20180101).first()
    assert (r.day_of_week, r.week_of_year, r.month_name, r.quarter) == (1, 1, "January", 1)
