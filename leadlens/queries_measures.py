"""Registrations of the BI measures and chart datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .oracle import sql as O
from .oracle.sql import rnd
from .plans import measures, texts
from .plans.channel import REC_RULES
from .plans.warehouse import Warehouse
from .queries_analytics import FIXTURE_REC_RULES, VIEW3_CTE
from .registry import register

_MONTH = {"lead": ("CAST(floor(f.date_key_first_contact / 10000) AS INTEGER) AS year, "
                   "CAST(floor(f.date_key_first_contact / 100) % 100 AS INTEGER) AS month"),
          "item": ("CAST(floor(i.date_key_purchase / 10000) AS INTEGER) AS year, "
                   "CAST(floor(i.date_key_purchase / 100) % 100 AS INTEGER) AS month")}


def _measures_sql(grain: str, r: dict) -> str:
    won = "CASE WHEN f.is_won = 1 AND f.days_to_close IS NOT NULL THEN f.days_to_close END"
    lead_aggs = (f"COUNT(*) AS mqls, CAST(SUM(f.is_won) AS BIGINT) AS closed_deals, "
                 f"quantile_cont({won}, 0.5) AS median_days_to_close, quantile_cont({won}, 0.75) AS p75_days_to_close")
    live = "i.days_after_won >= 0 AND i.order_status != 'canceled'"
    item_aggs = (f"SUM(i.price) AS rev, SUM(i.price + i.freight_value) AS gmv, SUM(i.freight_value) AS freight, "
                 f"COUNT(DISTINCT CASE WHEN {live} THEN i.seller_key END) AS active_sellers, "
                 f"COUNT(DISTINCT i.order_id) AS orders, SUM(i.review_score) AS review_sum, "
                 f"COUNT(i.review_score) AS review_n, "
                 f"SUM(CASE WHEN i.days_after_won >= 0 AND i.days_after_won <= 90 THEN i.price END) AS r90, "
                 f"SUM(CASE WHEN i.days_after_won >= 0 AND i.days_after_won <= 180 THEN i.price END) AS r180")
    v3 = VIEW3_CTE.strip() + """,
v3 AS (SELECT origin_name AS lead_origin, first_day AS d
       FROM placed JOIN dim_origin USING (origin_key) LEFT JOIN after USING (seller_key))"""
    if grain == "origin":
        keys, ctes = ["lead_origin"], f"""
ls AS (SELECT o.origin_name AS lead_origin, {lead_aggs} FROM fact_lead f JOIN dim_origin o ON f.origin_key = o.origin_key
       GROUP BY o.origin_name),
so AS (SELECT DISTINCT sl.seller_key, o.origin_name AS lead_origin FROM seller_lead sl
       JOIN dim_origin o ON sl.origin_key = o.origin_key),
its AS (SELECT so.lead_origin, {item_aggs} FROM fact_order_item i JOIN so ON i.seller_key = so.seller_key
        WHERE i.days_after_won >= 0 GROUP BY so.lead_origin),
{v3},
m10 AS (SELECT lead_origin, AVG(d) AS avg_days_to_first_order FROM v3 GROUP BY lead_origin),
m AS (SELECT ls.lead_origin, ls.mqls, ls.closed_deals, ls.median_days_to_close, ls.p75_days_to_close,
             its.rev, its.gmv, its.freight, its.active_sellers, its.orders, its.review_sum, its.review_n, its.r90, its.r180,
             m10.avg_days_to_first_order
      FROM ls LEFT JOIN its ON ls.lead_origin = its.lead_origin LEFT JOIN m10 ON ls.lead_origin = m10.lead_origin)"""
    elif grain == "overall":
        keys, ctes = [], f"""
ls AS (SELECT {lead_aggs} FROM fact_lead f),
its AS (SELECT {item_aggs} FROM fact_order_item i WHERE i.days_after_won >= 0),
{v3},
m10 AS (SELECT AVG(d) AS avg_days_to_first_order FROM v3),
m AS (SELECT * FROM ls, its, m10)"""
    else:
        keys, ctes = ["year", "month"], f"""
ls AS (SELECT {_MONTH['lead']}, {lead_aggs} FROM fact_lead f GROUP BY 1, 2),
its AS (SELECT {_MONTH['item']}, {item_aggs} FROM fact_order_item i WHERE i.days_after_won >= 0 GROUP BY 1, 2),
{v3},
opening AS (SELECT seller_key, CAST(floor(d / 100) AS INTEGER) AS ym
            FROM (SELECT seller_key, arg_min(date_key_purchase, (days_after_won, date_key_purchase)) AS d
                  FROM fact_order_item WHERE days_after_won >= 0 GROUP BY seller_key) f),
m10 AS (SELECT ym, AVG(first_day) AS days FROM placed JOIN after USING (seller_key) JOIN opening USING (seller_key) GROUP BY ym),
cal AS (SELECT DISTINCT year, month FROM dim_date),
m AS (SELECT cal.year, cal.month,
             ls.mqls, ls.closed_deals, ls.median_days_to_close, ls.p75_days_to_close,
             its.rev, its.gmv, its.freight, its.active_sellers, its.orders, its.review_sum, its.review_n, its.r90, its.r180,
             m10.days AS avg_days_to_first_order
      FROM cal LEFT JOIN ls ON ls.year = cal.year AND ls.month = cal.month
      LEFT JOIN its ON its.year = cal.year AND its.month = cal.month
      LEFT JOIN m10 ON m10.ym = cal.year * 100 + cal.month)"""
    z = lambda e: f"COALESCE({e}, CAST(0.0 AS DOUBLE))"
    d = lambda e: f"CAST({e} AS DOUBLE)"
    mq, cl = "CAST(COALESCE(mqls, 0) AS BIGINT)", "CAST(COALESCE(closed_deals, 0) AS BIGINT)"
    rev, gmv = z(d("rev")), z(d("gmv"))
    act = "CAST(COALESCE(active_sellers, 0) AS BIGINT)"
    ratio = lambda a, b: z(f"{d(a)} / {d(f'NULLIF({b}, 0)')}")
    _, lo, hi = O.wilson(cl, mq, 1.96)
    base = f"""SELECT {''.join(k + ', ' for k in keys)}{mq} AS mqls, {cl} AS closed_deals,
  {ratio(cl, mq)} AS conversion_rate, {lo} AS wilson_ci_lower, {hi} AS wilson_ci_upper,
  median_days_to_close, p75_days_to_close, avg_days_to_first_order,
  {rev} AS revenue_post_signing, {gmv} AS total_gmv, {ratio(rev, cl)} AS revenue_per_closed_deal,
  {act} AS active_sellers, {ratio(act, cl)} AS activation_rate, {ratio(rev, act)} AS revenue_per_active_seller,
  {ratio(rev, 'COALESCE(orders, 0)')} AS average_order_value,
  {d('review_sum')} / {d('review_n')} AS avg_review_score,
  {z(f"{d('freight')} / NULLIF({gmv}, 0)")} AS freight_share,
  {z(d('r90'))} AS revenue_90d, {z(d('r180'))} AS revenue_180d
FROM m"""
    if grain == "origin":
        over = (f"COALESCE(CAST(SUM(closed_deals) OVER () AS DOUBLE) / "
                f"CAST(NULLIF(SUM(mqls) OVER (), 0) AS DOUBLE), CAST(0.0 AS DOUBLE))")
        rank = "CAST(DENSE_RANK() OVER (ORDER BY revenue_per_closed_deal DESC) AS INTEGER)"
    else:
        over, rank = "conversion_rate", "CAST(NULL AS INTEGER)"
    top, slow, page, rest = (f"'{t}'" for t in texts.PERFORMANCE_TAGS)
    tag = (f"CASE WHEN conversion_rate >= {r['scale_conv']} AND revenue_per_closed_deal >= {r['scale_rev']} THEN {top} "
           f"WHEN conversion_rate >= {r['sdr_conv']} AND median_days_to_close > {r['sdr_days']} THEN {slow} "
           f"WHEN conversion_rate < {r['landing_conv']} AND revenue_per_closed_deal >= {r['landing_rev']} THEN {page} ELSE {rest} END")
    dcols = ["conversion_rate", "wilson_ci_lower", "wilson_ci_upper", "median_days_to_close", "p75_days_to_close",
             "avg_days_to_first_order", "revenue_post_signing", "total_gmv", "revenue_per_closed_deal",
             "activation_rate", "revenue_per_active_seller", "average_order_value", "avg_review_score",
             "freight_share", "revenue_90d", "revenue_180d", "overall_conversion_rate", "conversion_vs_overall"]
    icols = keys + ["mqls", "closed_deals", "active_sellers", "channel_rank", "performance_tag"]
    body = f"""
b2 AS ({base}),
b3 AS (SELECT *, {over} AS overall_conversion_rate, {rank} AS channel_rank FROM b2),
b4 AS (SELECT *, conversion_rate - overall_conversion_rate AS conversion_vs_overall, {tag} AS performance_tag FROM b3)"""
    sel = ", ".join(icols + [f"{rnd(c, 6)} AS {c}" for c in dcols])
    if grain != "month":
        return O.q(f"SELECT {sel} FROM b4", ctes + "," + body)
    ti = """,
b5 AS (SELECT b.*, LAG(revenue_post_signing, 12) OVER (ORDER BY year, month) AS revenue_prev_year,
              LAG(mqls, 12) OVER (ORDER BY year, month) AS mqls_prev_year,
              SUM(revenue_post_signing) OVER (PARTITION BY year ORDER BY month ROWS UNBOUNDED PRECEDING) AS revenue_ytd,
              SUM(mqls) OVER (PARTITION BY year ORDER BY month ROWS UNBOUNDED PRECEDING) AS mqls_ytd
       FROM b4 b)"""
    sel += (f", {rnd('revenue_prev_year', 6)} AS revenue_prev_year, mqls_prev_year, "
            f"{rnd('revenue_ytd', 6)} AS revenue_ytd, CAST(mqls_ytd AS BIGINT) AS mqls_ytd")
    return O.q(f"SELECT {sel} FROM b5", ctes + "," + body + ti)


@register("measures_by_origin", _measures_sql("origin", FIXTURE_REC_RULES))
def q_measures_by_origin(wh: Warehouse) -> DataFrame:
    """M1-M23 per channel."""
    return measures.rounded(measures.measures(wh, "origin", rules=FIXTURE_REC_RULES))


@register("measures_overall", _measures_sql("overall", FIXTURE_REC_RULES))
def q_measures_overall(wh: Warehouse) -> DataFrame:
    """M1-M21 over everything (one row)."""
    return measures.rounded(measures.measures(wh, "overall", rules=FIXTURE_REC_RULES))


@register("measures_monthly", _measures_sql("month", FIXTURE_REC_RULES))
def q_measures_monthly(wh: Warehouse) -> DataFrame:
    """M1-M21 per calendar month plus M24 time intelligence."""
    return measures.rounded(measures.measures(wh, "month", rules=FIXTURE_REC_RULES))


_TAG_COLS = ["lead_origin", "conversion_rate", "revenue_per_closed_deal", "median_days_to_close", "performance_tag"]


@register("performance_tag", "SELECT " + ", ".join(_TAG_COLS) + " FROM ("
          + _measures_sql("origin", FIXTURE_REC_RULES) + ") t")
def q_performance_tag(wh: Warehouse) -> DataFrame:
    """The DAX performance tag per channel, with the three inputs it reads."""
    return measures.rounded(measures.measures(wh, "origin", rules=FIXTURE_REC_RULES)).select(*_TAG_COLS)


@register("performance_tag_default_rules", "SELECT " + ", ".join(_TAG_COLS) + " FROM (" + _measures_sql("origin", REC_RULES) + ") t")
def q_performance_tag_default(wh: Warehouse) -> DataFrame:
    """R4/M23 with the thresholds that the reference states."""
    return measures.rounded(measures.measures(wh, "origin")).select(*_TAG_COLS)
