"""Published tables, range-refined quantiles, k-sample log-rank, dense calendar, key-arm bridge, non-finite JSON."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlens.operators.quantiles import interpolated_quantiles
from leadlens.plans import measures, primitives, stats
from leadlens.sources import published


# ---------------------------------------------------------------- S5
def test_refresh_replaces_and_reads_one_month(spark, tiny_wh, tmp_path):
    root = f"file://{tmp_path}/items"
    items = tiny_wh["fact_order_item"].withColumn("year_month", published.month_of("date_key_purchase"))
    assert published.publish(items, root, "year_month") == 1
    assert published.publish(items.filter("order_id <> 'o1'"), root, "year_month") == 2
    now = published.published(spark, root)
    assert sorted(r.order_id for r in now.collect()) == ["o2", "o3", "o4"]
    month = now.filter("year_month = 201803")
    assert [r.order_id for r in month.collect()] == ["o4"]
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan


def test_a_refresh_that_dies_leaves_the_old_version(spark, tiny_wh, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/items"
    items = tiny_wh["fact_order_item"].withColumn("year_month", published.month_of("date_key_purchase"))
    with pytest.raises(FileNotFoundError):
        published.published(spark, root)
    published.publish(items, root, "year_month")
    # dies among the rows, some of which may have been written
    broken = items.withColumn("price", F.when(F.col("order_id") == "o4", F.raise_error(F.lit("lost")).cast("decimal(10,2)")).otherwise(F.col("price")))
    with pytest.raises(Exception, match="lost"):
        published.publish(broken, root, "year_month")
    assert published.published(spark, root).count() == items.count()

    # dies between the data and the manifest
    def die(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(published, "_announce", die)
        with pytest.raises(RuntimeError):
            published.publish(items.limit(1), root, "year_month")
    assert published.published(spark, root).count() == items.count()
    assert published.publish(items.limit(2), root, "year_month") == 2
    assert published.published(spark, root).count() == 2


# ---------------------------------------------------------------- A9
@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_quantiles_match_numpy(spark, bins):
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(-10 ** 12, 10 ** 15, 301), "b": np.array([5]), "c": np.repeat([1, 1, 9], 40), None: rng.integers(0, 3, 50),
              "d": np.array([-2 ** 61, 2 ** 61, 0])}
    rows = [(g, int(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    qs = [0.0, 0.05, 0.5, 0.75, 1.0]
    got = {(r.g, r.q): r.v for r in interpolated_quantiles(df, ["g"], "v", qs, bins).collect()}
    assert len(got) == len(groups) * len(qs)
    for g, vs in groups.items():
        for q in qs:
            assert abs(got[g, q] - np.quantile(vs.astype(float), q)) <= 1e-9 * max(1, abs(got[g, q])), (g, q)
    one = interpolated_quantiles(df.filter("g = 'c'"), [], "v", [0.5], bins).collect()
    assert [(r.q, r.v) for r in one] == [(0.5, 1.0)]
    assert interpolated_quantiles(df.filter("g = 'e'"), ["g"], "v", qs, bins).collect() == []


# ---------------------------------------------------------------- T5
def test_k_sample_logrank_solves_its_terms(tiny_wh):
    terms = stats.logrank_components(tiny_wh, digits=None).collect()
    names = sorted({r.origin_a for r in terms})
    v, z = np.zeros((len(names),) * 2), np.zeros(len(names))
    for r in terms:
        a, b = names.index(r.origin_a), names.index(r.origin_b)
        v[a, b] = v[b, a] = r.v
        if a == b:
            z[a] = r.z
    want = z[:-1] @ np.linalg.pinv(v[:-1, :-1]) @ z[:-1]
    (got,) = stats.logrank_k(tiny_wh).collect()
    assert abs(got.chi2_stat - want) < 1e-3 and got.degrees_of_freedom == np.linalg.matrix_rank(v[:-1, :-1])
    assert 0 <= got.p_value <= 1 and got.is_statistically_significant == (got.p_value < 0.05)


# ---------------------------------------------------------------- M10, M24
def test_months_have_no_gaps(tiny_wh):
    rows = measures.measures(tiny_wh, "month").orderBy("year", "month").collect()
    assert [(r.year, r.month) for r in rows] == [(2017, 12)] + [(2018, m) for m in range(1, 13)]
    by = {(r.year, r.month): r for r in rows}
    assert by[2018, 6].mqls == 0 and by[2018, 6].revenue_post_signing == 0 and by[2018, 6].median_days_to_close is None
    assert by[2018, 12].mqls_prev_year == by[2017, 12].mqls == 0 and by[2018, 11].mqls_prev_year is None
    assert by[2018, 12].mqls_ytd == sum(r.mqls for r in rows) == 6
    # the first post-signing orders: s1 on the day it signed (January), s2 in February (canceled counts, as in view 3)
    first = {k: r.avg_days_to_first_order for k, r in by.items() if r.avg_days_to_first_order is not None}
    assert set(first) == {(2018, 1), (2018, 2)} and first[2018, 1] == 0.0
    overall = measures.measures(tiny_wh, "overall").first().avg_days_to_first_order
    n = {(2018, 1): 1, (2018, 2): 2}                       # s2 stands for two leads
    assert abs(sum(first[k] * n[k] for k in n) / 3 - overall) < 1e-9


# ---------------------------------------------------------------- J5, A2
def test_key_arm_is_part_of_both_arms(spark, tiny_raw, tiny_wh):
    from leadlens.plans.warehouse import build_warehouse
    pairs = {tuple(r) for r in primitives.or_join_key_arm(tiny_wh).collect()}
    assert pairs and pairs <= {tuple(r) for r in primitives.or_join_pairs(tiny_wh).collect()}
    wh = build_warehouse(spark, tiny_raw, ("2017-12-01", "2018-12-31"), id_arm=False)
    assert {(r.seller_id, r.mql_id) for r in wh["seller_lead"].collect()} == pairs


def test_sketches_are_near_the_exact_count(tiny_wh):
    assert all(r.within_error for r in primitives.sketched_orders(tiny_wh).collect())


# ---------------------------------------------------------------- T6
def resampled(revenue, reps, chunk, seed=7):
    import pandas as pd
    run = stats.replicate_sums({"o": len(revenue)}, reps, seed, chunk)
    total = np.zeros(reps)
    for c in range(-(-len(revenue) // chunk)):
        part = pd.DataFrame({"total_revenue": revenue[c * chunk:(c + 1) * chunk]})
        total += run(("o", c), part)["total"].to_numpy()
    return total


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_split_counts_are_multinomial(chunk):
    n, reps = 40, 6000
    # every replicate draws n deals in all
    assert (resampled(np.ones(n), reps, chunk) == n).all()
    # the count of one deal: mean 1, variance 1 - 1/n; of two deals: covariance -1/n
    one, other = (resampled(np.eye(n)[k], reps, chunk) for k in (3, 38))
    assert abs(one.mean() - 1) < 0.06 and abs(one.var() - (1 - 1 / n)) < 0.08
    both = resampled(np.eye(n)[3] + 100 * np.eye(n)[38], reps, chunk)
    a, b = both % 100, both // 100
    assert abs(np.cov(a, b)[0, 1] + 1 / n) < 0.06 and abs(b.mean() - 1) < 0.06


def test_split_interval_agrees_with_the_md5_form(spark):
    import __spark_entry__
    queries = __spark_entry__.queries()
    sf = "/root/testdata/sf0.01"
    split = {r.origin: r for r in queries["bootstrap_ci_split"](spark, sf).collect()}
    exact = {r.origin: r for r in queries["bootstrap_ci"](spark, sf).collect()}
    assert split.keys() == exact.keys()
    for o, e in exact.items():
        s, width = split[o], e.boot_ci_upper - e.boot_ci_lower
        assert (s.closed_deals, s.mean_revenue_per_deal) == (e.closed_deals, e.mean_revenue_per_deal)
        # the standard error of a 2.5 % quantile of 1,000 replicates is about 0.02 of the width
        assert abs(s.boot_ci_lower - e.boot_ci_lower) < 0.12 * width and abs(s.boot_ci_upper - e.boot_ci_upper) < 0.12 * width
