"""Analyses on the hand-made warehouse (SURVEY C*, T*, R*, Q*)."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_channel_matrix_tiny(tiny_wh):
    from leadlens.plans.revenue import channel_matrix
    m = {r.lead_origin: r for r in channel_matrix(tiny_wh).collect()}
    assert m["paid_search"].total_mqls == 2 and m["paid_search"].closed_deals == 2
    # post-signing, non-canceled: o2 (20.00, s1) and o4 (40.00, s2; p3 mapped)
    assert m["paid_search"].total_post_signing_revenue == 60.0
    assert m["unknown"].closed_deals == 0 and m["unknown"].activation_rate is None


def test_audit_counts(tiny_wh):
    from leadlens.plans import audit
    dups = dict((r.metric, r.value) for r in audit.audit_dups(tiny_wh).collect())
    assert dups == {"mql_duplicates": 0, "closed_mql_duplicates": 0, "seller_id_duplicates": 1}
    assert audit.audit_orphans(tiny_wh).first().value == 1
    assert audit.audit_date_sanity(tiny_wh).first().value == 1
    rej = dict((r.reason, r.violations) for r in audit.rejects(tiny_wh).collect())
    assert rej["unmapped_product"] == 1 and rej["no_order"] == 0
    status = {r.metric: r.status for r in audit.audit_status(tiny_wh).collect()}
    assert status["items_loaded_minus_input"] == "PASS" and status["orphan_closed_mqls"] == "FAIL"


def test_km_properties(tiny_wh):
    from leadlens.plans.stats import km_curve
    c = km_curve(tiny_wh).orderBy("origin", "time").collect()
    by = {}
    for r in c:
        by.setdefault(r.origin, []).append(r.survival)
    for s in by.values():
        assert all(a >= b for a, b in zip(s, s[1:]))          # non-increasing
    assert by["unknown"] == [1.0]                              # all censored


def test_chi_square_two_groups_yates(spark):
    from leadlens.plans.stats import chi_square
    from leadlens.plans.warehouse import Warehouse
    # 2 x 2 table: won 30/100 vs 10/100; expected 20/80 per row, |O-E| = 10,
    # Yates: 2 * (9.5^2/20 + 9.5^2/80) = 11.28125, p = 0.000783 (dof 1)
    rows = ([(1, 1)] * 30 + [(1, 0)] * 70 + [(2, 1)] * 10 + [(2, 0)] * 90)
    fl = spark.createDataFrame(rows, "origin_key long, is_won int")
    do = spark.createDataFrame([(1, "a"), (2, "b")], "origin_key long, origin_name string")
    wh = Warehouse(spark, "/tmp", tables={"fact_lead": fl, "dim_origin": do}, rows={"dim_origin": 2})
    r = chi_square(wh, with_p=True).first()
    assert r.degrees_of_freedom == 1 and r.chi2_stat == 11.281
    assert abs(r.p_value - 0.000783) < 1e-5


def test_bootstrap_seeded_and_degenerate(tiny_wh):
    from leadlens.plans.stats import bootstrap_ci
    a = sorted(tuple(r) for r in bootstrap_ci(tiny_wh, reps=50, seed=7).collect())
    b = sorted(tuple(r) for r in bootstrap_ci(tiny_wh, reps=50, seed=7).collect())
    assert a == b
    for r in a:                                   # n <= 2 everywhere here -> degenerate
        assert r[3] == r[2] == r[4]


def test_bootstrap_resolves_draws_by_one_narrow_key(spark):
    """Draws meet the shipped deals by one number, whatever their channel, and pick the deals of the formula."""
    import hashlib

    import numpy as np
    from leadlens.plans.stats import bootstrap_ci
    from leadlens.plans.warehouse import Warehouse
    rows = [(k, "ab"[k % 3 == 0], "s", float(k * k % 101)) for k in range(1, 61)]
    wh = Warehouse(spark, "/tmp", derived_tables={
        "deals_with_revenue": spark.createDataFrame(rows, "lead_key long, origin string, segment string, total_revenue double")})
    got = bootstrap_ci(wh, reps=40, seed=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_gk" in plan and "idx" not in plan
    for r in got.collect():
        v = [x[3] for x in rows if x[1] == r.origin]
        pick = lambda rep, j: int(hashlib.md5(f"7|{r.origin}|{rep}|{j}".encode()).hexdigest()[:15], 16) % len(v)
        means = [np.mean([v[pick(rep, j)] for j in range(1, len(v) + 1)]) for rep in range(40)]
        assert abs(r.boot_ci_lower - np.percentile(means, 2.5)) < 0.0051 and abs(r.boot_ci_upper - np.percentile(means, 97.5)) < 0.0051


def test_scenario_zero_within_one_deal(tiny_wh):
    from leadlens.plans import channel
    from leadlens.plans.revenue import channel_matrix
    m = channel_matrix(tiny_wh)
    rows, totals = channel.scenario_projection(m, channel.uniform_scenarios(m, [0.0]))
    for r in rows.collect():
        assert abs(r.simulated_deals - r.baseline_deals) <= 1


def test_recommendation_null_falls_through(tiny_wh):
    from leadlens.plans import channel
    from leadlens.plans.revenue import channel_matrix
    recs = {r.origin: r.strategy for r in channel.recommendations(channel_matrix(tiny_wh)).collect()}
    assert recs["unknown"] == "DEPRECATE OR REALLOCATE SPEND"


def test_heatmap_suppression(spark):
    from leadlens.plans import stats
    from leadlens.plans.warehouse import Warehouse
    deals = spark.createDataFrame([(i, "o", "s9" if i < 9 else "s10", 1.0) for i in range(19)],
                                  "lead_key long, origin string, segment string, total_revenue double")
    orig = stats.deals_with_revenue
    stats.deals_with_revenue = lambda wh: deals
    try:
        h = {r.segment_name: r for r in stats.heatmap(Warehouse(spark, "/tmp")).collect()}
    finally:
        stats.deals_with_revenue = orig
    assert h["s9"].suppressed and h["s9"].display_avg_rev is None
    assert not h["s10"].suppressed and h["s10"].display_avg_rev == 1.0


def _logrank_brute(rows):
    """k-sample log-rank from its definition, over (group, duration, event) rows."""
    import numpy as np
    groups = sorted({g for g, _, _ in rows})
    k = len(groups)
    Z, V = np.zeros(k), np.zeros((k, k))
    for t in sorted({t for _, t, e in rows if e}):
        n_g = np.array([sum(1 for g, u, _ in rows if g == gi and u >= t) for gi in groups], float)
        d_g = np.array([sum(1 for g, u, e in rows if g == gi and u == t and e) for gi in groups], float)
        n, d = n_g.sum(), d_g.sum()
        Z += d_g - d * n_g / n
        if n > 1:
            w = d * (n - d) / (n - 1)
            V += w * (np.diag(n_g / n) - np.outer(n_g / n, n_g / n))
    return float(Z[:-1] @ np.linalg.solve(V[:-1, :-1], Z[:-1])), k - 1


def test_logrank_components_match_brute_force(spark):
    import os
    from leadlens.plans.context import warehouse_for
    from leadlens.plans.stats import _durations, logrank_components
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    wh = warehouse_for(spark, sf)
    d, _ = _durations(wh)
    rows = [(r.origin, r.t, r.e) for r in d.collect()]        # 150 leads at this scale
    chi2, dof = _logrank_brute(rows)
    got = logrank_components(wh).collect()
    at = {g: i for i, g in enumerate(sorted({r.origin_a for r in got}))}
    assert len(at) == dof + 1 and len(got) == len(at) * (len(at) + 1) // 2
    z, v = np.zeros(len(at)), np.zeros((len(at), len(at)))
    for r in got:
        v[at[r.origin_a], at[r.origin_b]] = v[at[r.origin_b], at[r.origin_a]] = r.v
        if r.origin_a == r.origin_b:
            z[at[r.origin_a]] = r.z
    assert float(z[:-1] @ np.linalg.solve(v[:-1, :-1], z[:-1])) == pytest.approx(chi2, abs=1e-3)
