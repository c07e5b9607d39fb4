"""Registrations of the statistics queries with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .oracle import sql as O
from .oracle.sql import rnd
from .plans import stats
from .plans.warehouse import Warehouse
from .registry import register

_CHI = f"""
c AS (SELECT o.origin_name, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(f.is_won) AS DOUBLE) AS k
      FROM fact_lead f JOIN dim_origin o ON f.origin_key = o.origin_key GROUP BY o.origin_name),
t AS (SELECT *, SUM(n) OVER () AS nn, SUM(k) OVER () AS kk, COUNT(*) OVER () AS r FROM c),
dv AS (SELECT r, nn, abs(k - n * kk / nn) AS d1, n * kk / nn AS e1,
              abs((n - k) - n * (nn - kk) / nn) AS d0, n * (nn - kk) / nn AS e0 FROM t),
terms AS (SELECT r, nn,
          pow(CASE WHEN r = 2 THEN d1 - least(0.5, d1) ELSE d1 END, 2) / e1
        + pow(CASE WHEN r = 2 THEN d0 - least(0.5, d0) ELSE d0 END, 2) / e0 AS term FROM dv)"""


@register("chi_square", O.q(f"""
SELECT {rnd('SUM(term)', 3)} AS chi2_stat, CAST(MAX(r) - 1 AS INTEGER) AS degrees_of_freedom,
       {rnd('sqrt(SUM(term) / (MAX(nn) * (least(MAX(r), 2) - 1)))', 4)} AS cramers_v
FROM terms""", _CHI))
def q_chi_square(wh: Warehouse) -> DataFrame:
    """T3 chi-square independence of origin x won (statistic, dof, Cramer's V)."""
    return stats.chi_square(wh)


@register("chi_square_p", O.q(f"""
SELECT {rnd('chi2', 3)} AS chi2_stat, CAST(dof AS INTEGER) AS degrees_of_freedom, {rnd('cv', 4)} AS cramers_v,
       {rnd('p', 9)} AS p_value, {rnd('p', 9)} < 0.05 AS is_statistically_significant
FROM (SELECT chi2, dof, cv, CASE WHEN chi2 <= 0 THEN CAST(1.0 AS DOUBLE) WHEN h > 600 AND h > 4 * a THEN CAST(0.0 AS DOUBLE)
             ELSE greatest(CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) - (
               SELECT SUM(exp((a + i) * ln(h) - h - lgamma(a + i + 1))) FROM range(0, 3000) r(i))) END AS p
      FROM (SELECT chi2, dof, cv, chi2 / 2 AS h, dof / CAST(2.0 AS DOUBLE) AS a
            FROM (SELECT SUM(term) AS chi2, MAX(r) - 1 AS dof, sqrt(SUM(term) / (MAX(nn) * (least(MAX(r), 2) - 1))) AS cv
                  FROM terms) x) y) z""", _CHI))
def q_chi_square_p(wh: Warehouse) -> DataFrame:
    """T3 with p-value (chi-square upper tail by its series) and significance."""
    return stats.chi_square(wh, with_p=True)


_KM = """
maxd AS (SELECT COALESCE(MAX(days_to_close), 90) AS m FROM fact_lead),
dur AS (SELECT o.origin_name AS origin, COALESCE(f.days_to_close, (SELECT m FROM maxd)) AS t, f.is_won AS e
        FROM fact_lead f JOIN dim_origin o ON f.origin_key = o.origin_key),
h AS (SELECT origin, t, CAST(SUM(e) AS BIGINT) AS d, COUNT(*) AS m FROM dur GROUP BY origin, t),
h2 AS (SELECT *, SUM(m) OVER (PARTITION BY origin ORDER BY t DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_at_risk FROM h),
h3 AS (SELECT *, PRODUCT(CAST(1.0 AS DOUBLE) - CAST(d AS DOUBLE) / CAST(n_at_risk AS DOUBLE))
                 OVER (PARTITION BY origin ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS survival
       FROM h2)"""


@register("km_curve", O.q(f"""
SELECT origin, 1 AS step, t AS "time", CAST(n_at_risk AS BIGINT) AS n_at_risk, d AS events, m - d AS censored,
       {rnd('survival', 4)} AS survival FROM h3
UNION ALL
SELECT origin, 0, 0, COUNT(*), 0, 0, CAST(1.0 AS DOUBLE) FROM dur GROUP BY origin""", _KM))
def q_km_curve(wh: Warehouse) -> DataFrame:
    """T4 Kaplan-Meier curve per origin (unwon leads censored), each behind its start row."""
    return stats.km_curve_from_start(wh)


@register("km_median", O.q(f"""
SELECT origin, CAST(COALESCE(MIN(CASE WHEN {rnd('survival', 12)} <= 0.5 THEN t END), (SELECT m FROM maxd)) AS INTEGER) AS median_days
FROM h3 GROUP BY origin""", _KM))
def q_km_median(wh: Warehouse) -> DataFrame:
    """T4 Kaplan-Meier median time to close per origin."""
    return stats.km_median(wh)


@register("logrank_pairwise", O.q(f"""
SELECT origin_a, origin_b, {rnd('SUM(oe) * SUM(oe) / SUM(v)', 4)} AS chi2_stat
FROM (SELECT origin_a, origin_b, da - d * (na / n) AS oe,
             CASE WHEN n > 1 THEN d * (na / n) * (CAST(1.0 AS DOUBLE) - na / n) * (n - d) / (n - 1)
                  ELSE CAST(0.0 AS DOUBLE) END AS v
      FROM p WHERE d > 0) q
GROUP BY origin_a, origin_b""", _KM + """,
times AS (SELECT DISTINCT t FROM dur WHERE e = 1),
ar AS (SELECT dur.origin, times.t, COUNT(*) AS n_g,
              SUM(CASE WHEN dur.t = times.t AND dur.e = 1 THEN 1 ELSE 0 END) AS d_g
       FROM dur JOIN times ON dur.t >= times.t GROUP BY dur.origin, times.t),
p AS (SELECT a.origin AS origin_a, b.origin AS origin_b, CAST(a.n_g + b.n_g AS DOUBLE) AS n,
             CAST(a.d_g + b.d_g AS DOUBLE) AS d, a.n_g AS na, a.d_g AS da
      FROM ar a JOIN ar b ON a.t = b.t AND a.origin < b.origin)"""))
def q_logrank_pairwise(wh: Warehouse) -> DataFrame:
    """T5 two-sample log-rank statistic for each pair of origins."""
    return stats.logrank_pairwise(wh)


_GRID = """,
times AS (SELECT DISTINCT t FROM dur WHERE e = 1),
ar AS (SELECT dur.origin, times.t, COUNT(*) AS n_g, SUM(CASE WHEN dur.t = times.t AND dur.e = 1 THEN 1 ELSE 0 END) AS d_g
       FROM dur JOIN times ON dur.t >= times.t GROUP BY dur.origin, times.t),
grid AS (SELECT origin, t, d_g, CAST(d AS DOUBLE) AS d, CAST(n_g AS DOUBLE) / n AS share,
                CASE WHEN n > 1 THEN CAST(d * (n - d) AS DOUBLE) / (n - 1) ELSE CAST(0.0 AS DOUBLE) END AS w
         FROM (SELECT *, SUM(n_g) OVER (PARTITION BY t) AS n, SUM(d_g) OVER (PARTITION BY t) AS d FROM ar) q)"""


@register("logrank_components", O.q(f"""
SELECT a.origin AS origin_a, b.origin AS origin_b,
       {rnd('SUM(CASE WHEN a.origin = b.origin THEN a.d_g - a.d * a.share END)', 6)} AS z,
       {rnd('SUM(a.w * a.share * (CASE WHEN a.origin = b.origin THEN 1 ELSE 0 END - b.share))', 6)} AS v
FROM grid a JOIN grid b ON a.t = b.t AND a.origin <= b.origin GROUP BY a.origin, b.origin""", _KM + _GRID))
def q_logrank_components(wh: Warehouse) -> DataFrame:
    """T5 terms of the k-sample log-rank statistic across all origins."""
    return stats.logrank_components(wh)


def _solve_sql(pivots: int) -> str:
    """Gauss steps over a long table (r, c, x), c = 0 the right-hand side: one table a pivot."""
    ctes = [f"""
num AS (SELECT origin, ROW_NUMBER() OVER (ORDER BY origin) AS i, COUNT(*) OVER () AS k FROM (SELECT DISTINCT origin FROM grid) o),
e0 AS MATERIALIZED (
  SELECT p.i AS r, q.i AS c, SUM(a.w * a.share * (CASE WHEN a.origin = b.origin THEN 1 ELSE 0 END - b.share)) AS x
  FROM grid a JOIN grid b ON a.t = b.t JOIN num p ON p.origin = a.origin JOIN num q ON q.origin = b.origin
  WHERE p.i < p.k AND q.i < q.k GROUP BY 1, 2
  UNION ALL SELECT p.i, 0, SUM(a.d_g - a.d * a.share) FROM grid a JOIN num p ON p.origin = a.origin WHERE p.i < p.k GROUP BY 1)"""]
    for n in range(1, pivots + 1):
        before = f"e{n - 1}"
        ctes.append(f"""
e{n} AS MATERIALIZED (
  SELECT m.r, m.c, CASE WHEN m.r > {n} AND d.x > CAST(1e-9 AS DOUBLE) THEN m.x - f.x / d.x * y.x ELSE m.x END AS x
  FROM {before} m LEFT JOIN {before} d ON d.r = {n} AND d.c = {n} LEFT JOIN {before} f ON f.r = m.r AND f.c = {n}
  LEFT JOIN {before} y ON y.r = {n} AND y.c = m.c)""")
    return ",".join(ctes) + f""",
pivots AS (SELECT d.r, d.x AS d, b.x AS b FROM e{pivots} d JOIN e{pivots} b ON b.r = d.r AND b.c = 0 WHERE d.c = d.r AND d.x > CAST(1e-9 AS DOUBLE)),
stat AS (SELECT SUM(b * b / d) AS chi2, COUNT(*) AS dof FROM pivots)"""


@register("logrank_k", O.q(f"""
SELECT {rnd('chi2', 4)} AS chi2_stat, CAST(dof AS INTEGER) AS degrees_of_freedom, {rnd('p', 9)} AS p_value, p < 0.05 AS is_statistically_significant
FROM (SELECT *, CASE WHEN chi2 <= 0 THEN CAST(1.0 AS DOUBLE) WHEN h > 600 AND h > 4 * a THEN CAST(0.0 AS DOUBLE)
             ELSE greatest(CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) - (
               SELECT SUM(exp((a + i) * ln(h) - h - lgamma(a + i + 1))) FROM range(0, 3000) r(i))) END AS p
      FROM (SELECT *, chi2 / 2 AS h, dof / CAST(2.0 AS DOUBLE) AS a FROM stat) x) y""", _KM + _GRID + "," + _solve_sql(10)))
def q_logrank_k(wh: Warehouse) -> DataFrame:
    """T5 k-sample log-rank test across all origins: statistic, degrees of freedom, p-value."""
    return stats.logrank_k(wh)


_DEALS = """
rev AS (SELECT seller_key, SUM(price) AS rev FROM fact_order_item WHERE days_after_won >= 0 GROUP BY seller_key),
deals AS (SELECT f.lead_key, o.origin_name AS origin, s.segment_name AS segment,
                 COALESCE(CAST(r.rev AS DOUBLE), CAST(0.0 AS DOUBLE)) AS total_revenue
          FROM fact_lead f JOIN dim_origin o ON f.origin_key = o.origin_key
          JOIN dim_segment s ON f.segment_key = s.segment_key
          LEFT JOIN rev r ON f.seller_key = r.seller_key WHERE f.is_won = 1),
g AS (SELECT origin, COUNT(*) AS n, AVG(total_revenue) AS mean FROM deals GROUP BY origin)"""

_CI_SELECT = f"""
SELECT g.origin, g.n AS closed_deals, {rnd('g.mean', 2)} AS mean_revenue_per_deal,
       {rnd('CASE WHEN g.n > 2 THEN ci.lo ELSE g.mean END', 2)} AS boot_ci_lower,
       {rnd('CASE WHEN g.n > 2 THEN ci.hi ELSE g.mean END', 2)} AS boot_ci_upper
FROM g LEFT JOIN ci ON g.origin = ci.origin"""


def _hash(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


@register("bootstrap_ci", O.q(_CI_SELECT, _DEALS + f""",
numbered AS (SELECT origin, ROW_NUMBER() OVER (PARTITION BY origin ORDER BY lead_key) AS idx, total_revenue FROM deals),
reps AS (SELECT origin, n, unnest(generate_series(0, 999)) AS rep FROM g WHERE n > 2),
draws AS (SELECT origin, rep, n, unnest(generate_series(1, n)) AS j FROM reps),
drawn AS (SELECT origin, rep, 1 + ({_hash("'42'", 'origin', 'CAST(rep AS VARCHAR)', 'CAST(j AS VARCHAR)')} % n) AS idx
          FROM draws),
means AS (SELECT d.origin, d.rep, AVG(nb.total_revenue) AS m
          FROM drawn d JOIN numbered nb ON d.origin = nb.origin AND d.idx = nb.idx GROUP BY d.origin, d.rep),
ci AS (SELECT origin, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY origin)"""))
def q_bootstrap_ci(wh: Warehouse) -> DataFrame:
    """T6 seeded bootstrap CI (B = 1,000) of revenue per closed deal by origin."""
    return stats.bootstrap_ci(wh, reps=1000, seed=42)


def _poisson_w(h: str) -> str:
    return " + ".join(f"CASE WHEN {h} >= {level} THEN 1 ELSE 0 END" for level in stats.POISSON1)


@register("bootstrap_ci_poisson", O.q(_CI_SELECT, _DEALS + f""",
x AS (SELECT lead_key, origin, total_revenue, unnest(generate_series(0, 999)) AS rep FROM deals),
xh AS (SELECT origin, rep, total_revenue, {_hash("'42'", 'CAST(lead_key AS VARCHAR)', 'CAST(rep AS VARCHAR)')} AS h FROM x),
xw AS (SELECT origin, rep, total_revenue, {_poisson_w('h')} AS w FROM xh),
means AS (SELECT origin, rep, SUM(w * total_revenue) / CAST(SUM(w) AS DOUBLE) AS m FROM xw GROUP BY origin, rep),
ci AS (SELECT origin, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY origin)"""))
def q_bootstrap_ci_poisson(wh: Warehouse) -> DataFrame:
    """T6 Poisson(1) bootstrap CI (B = 1,000), the shuffle-light form for large channels."""
    return stats.bootstrap_ci_poisson(wh, reps=1000, seed=42)


@register("bootstrap_ci_split")
def q_bootstrap_ci_split(wh: Warehouse) -> DataFrame:
    """T6 exact multinomial bootstrap CI (B = 1,000) by binomial splits (no SQL form: tested against the md5 form)."""
    return stats.bootstrap_ci_split(wh, reps=1000, seed=42)


@register("heatmap", O.q(f"""
SELECT segment AS segment_name, origin AS origin_name, COUNT(*) AS n_deals,
       {rnd('SUM(total_revenue)', 2)} AS total_rev, {rnd('AVG(total_revenue)', 2)} AS avg_rev,
       COUNT(*) < 10 AS suppressed,
       CASE WHEN COUNT(*) >= 10 THEN {rnd('AVG(total_revenue)', 2)} END AS display_avg_rev
FROM deals GROUP BY segment, origin""", _DEALS))
def q_heatmap(wh: Warehouse) -> DataFrame:
    """T7 segment x origin revenue-per-deal matrix with n < 10 suppression (long form)."""
    return stats.heatmap(wh)


# The channel names of the driver's tables (cleaned market segments), each a column of the wide matrix.
CHANNELS = ["automobile", "building", "furniture", "machinery", "unknown"]


@register("heatmap_pivot", O.q("SELECT segment AS segment_name, " + ", ".join(f"""
       {rnd(f"CASE WHEN COUNT(*) FILTER (WHERE origin = '{c}') >= 10 THEN AVG(total_revenue) FILTER (WHERE origin = '{c}') END", 2)}
         AS "{c}\"""" for c in CHANNELS) + """
FROM deals GROUP BY segment""", _DEALS))
def q_heatmap_pivot(wh: Warehouse) -> DataFrame:
    """T7/A14 wide segment x origin matrix."""
    return stats.heatmap_pivot(wh)
