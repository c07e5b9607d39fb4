"""Channel-level KPIs and decision operators.

All of these read the channel matrix (C12), i.e. one row per channel, and
add Column arithmetic; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_text, money_text, pct_text, roi_band, safe_ratio
from . import texts

# Estimated acquisition cost per lead by channel, and the
# default for channels not listed.
BASE_CAC = {
    "paid_search": 45.0,
    "organic_search": 15.0,
    "social": 35.0,
    "direct_traffic": 10.0,
    "email": 12.0,
    "referral": 20.0,
    "organic_social": 18.0,
    "display": 40.0,
    "other": 30.0,
    "unknown": 25.0,
}
DEFAULT_CAC = 25.0


def cac_column(channel: str | Column, cac: dict[str, float] | None = None,
               default: float = DEFAULT_CAC) -> Column:
    """Constant-table lookup with a default, as a literal map (10 entries)."""
    table = cac or BASE_CAC
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
    c = F.col(channel) if isinstance(channel, str) else channel
    return F.coalesce(F.try_element_at(m, c), F.lit(float(default)))


def overview_kpis(matrix: DataFrame) -> DataFrame:
    """One-row executive summary over the channel matrix."""
    t = matrix.agg(F.sum("total_mqls").cast("long").alias("total_mqls"),
                   F.sum("closed_deals").cast("long").alias("total_closed_deals"),
                   F.sum("total_post_signing_revenue").alias("rev"),
                   F.sum("active_sellers").cast("long").alias("active_sellers"),
                   F.avg("avg_days_to_close").alias("days"))
    return t.select(
        "total_mqls", "total_closed_deals",
        F.coalesce(F.round(safe_ratio("total_closed_deals", "total_mqls"), 4), F.lit(0.0)).alias("overall_conversion_rate"),
        F.round("rev", 2).alias("total_post_signing_revenue"),
        F.coalesce(F.round(safe_ratio("rev", "total_closed_deals"), 2), F.lit(0.0)).alias("revenue_per_closed_deal"),
        "active_sellers",
        F.coalesce(F.round(safe_ratio("active_sellers", "total_closed_deals"), 4), F.lit(0.0)).alias("activation_rate"),
        F.round("days", 1).alias("avg_days_to_close"))


def channel_roi(matrix: DataFrame, cac: dict[str, float] | None = None) -> DataFrame:
    """C14: estimated spend, net profit, ROI multiple and payback per channel."""
    c = cac_column("lead_origin", cac)
    m = matrix.select("lead_origin", "total_mqls", "closed_deals", "revenue_per_closed_deal",
                      "total_post_signing_revenue", c.alias("est_cac"))
    spend = F.col("total_mqls") * F.col("est_cac")
    rev = F.col("total_post_signing_revenue")
    rd = F.col("revenue_per_closed_deal")
    out = m.select(
        F.col("lead_origin").alias("origin"), "total_mqls", "closed_deals", "est_cac",
        F.round(spend, 2).alias("total_estimated_spend"),
        F.round(rev, 2).alias("total_post_signing_revenue"),
        F.round(rev - spend, 2).alias("net_profit"),
        F.when(spend > 0, F.round(F.try_divide(rev, spend), 2)).otherwise(F.lit(0.0)).alias("roi_multiple"),
        F.when(rd > 0, F.round(F.try_divide(F.col("est_cac"), F.try_divide(rd, F.lit(12.0))), 1))
         .otherwise(F.lit(0.0)).alias("payback_months"))
    return out.withColumn("roi_band", roi_band("roi_multiple")).orderBy(F.desc("roi_multiple"))


# Rule thresholds of the recommendation engine.
REC_RULES = {"scale_conv": 0.10, "scale_rev": 500.0, "sdr_conv": 0.08, "sdr_days": 25.0,
             "landing_conv": 0.07, "landing_rev": 600.0}


def _filled(text: str, shown: dict[str, Column]) -> Column:
    return F.concat(*[shown[part] if slot else F.lit(part) for slot, part in texts.pieces(text)])


def recommendations(matrix: DataFrame, rules: dict[str, float] | None = None) -> DataFrame:
    """First matching rule per channel -> strategy, badge, action, rationale."""
    r = {**REC_RULES, **(rules or {})}
    conv, days, rev, act = (F.col("conversion_rate"), F.col("avg_days_to_close"),
                            F.col("revenue_per_closed_deal"), F.col("activation_rate"))
    rule = (F.when((conv >= r["scale_conv"]) & (rev >= r["scale_rev"]), 1)
            .when((conv >= r["sdr_conv"]) & (days > r["sdr_days"]), 2)
            .when((conv < r["landing_conv"]) & (rev >= r["landing_rev"]), 3)
            .otherwise(4))
    shown = {"conversion": pct_text(conv), "revenue": money_text(rev), "days": F.format_number(days, 1)}
    by_rule = lambda values: F.element_at(F.array(*values), F.col("_rule"))
    strategy, badge, action = (by_rule([F.lit(r[k]) for r in texts.RECOMMENDATIONS]) for k in range(3))
    reason = by_rule([_filled(r[3], shown) for r in texts.RECOMMENDATIONS])
    return (matrix.withColumn("_rule", rule).select(
        F.col("lead_origin").alias("origin"), strategy.alias("strategy"), badge.alias("badge_color"),
        F.round(conv * 100, 2).alias("conversion_rate"),
        F.round(days, 1).alias("avg_days_to_close"),
        F.round(rev, 2).alias("revenue_per_deal"),
        F.round(act * 100, 2).alias("activation_rate"),
        action.alias("recommended_action"), reason.alias("strategic_rationale"))
        .orderBy(F.desc("revenue_per_deal")))


# Anomaly thresholds.
ANOMALY_RULES = {"volume_mqls": 1000, "volume_sd": 0.5, "leak_conv": 0.08, "leak_act": 0.60,
                 "slow_rev": 500.0, "slow_days": 22.0}


def anomalies(matrix: DataFrame, rules: dict[str, float] | None = None) -> DataFrame:
    """R2: 0-3 alerts per channel; mean/sd of conversion come from a 1-row aggregate."""
    r = {**ANOMALY_RULES, **(rules or {})}
    every = Window.partitionBy()   # the matrix holds one row per channel
    m = matrix.select("*", F.avg("conversion_rate").over(every).alias("_mean"),
                      F.stddev_samp("conversion_rate").over(every).alias("_sd"))
    conv, mqls, act = F.col("conversion_rate"), F.col("total_mqls"), F.col("activation_rate")
    rev, days = F.col("revenue_per_closed_deal"), F.col("avg_days_to_close")
    shown = {"mqls": count_text(mqls), "conversion": pct_text(conv), "activation": pct_text(act), "revenue": money_text(rev),
             "days": F.format_number(days, 1)}
    tests = [(mqls >= r["volume_mqls"]) & (conv < F.col("_mean") - r["volume_sd"] * F.col("_sd")),
             (conv >= r["leak_conv"]) & (act < r["leak_act"]), (rev >= r["slow_rev"]) & (days > r["slow_days"])]
    alerts = F.array(*[F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), _filled(metric, shown).alias("metric"),
                                             F.lit(insight).alias("insight"), F.lit(advice).alias("recommendation")))
                       for test, (kind, severity, metric, insight, advice) in zip(tests, texts.ANOMALIES)])
    return (m.select(F.col("lead_origin").alias("origin"),
                     F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("a"))
             .select("a.type", "a.severity", "origin", "a.metric", "a.insight", "a.recommendation"))


def performance_tag(conv: Column, rev_deal: Column, median_days: Column,
                    rules: dict[str, float] | None = None) -> Column:
    """The DAX tag (median days where R1 uses mean days)."""
    r = {**REC_RULES, **(rules or {})}
    top, slow, page, rest = texts.PERFORMANCE_TAGS
    return (F.when((conv >= r["scale_conv"]) & (rev_deal >= r["scale_rev"]), top)
            .when((conv >= r["sdr_conv"]) & (median_days > r["sdr_days"]), slow)
            .when((conv < r["landing_conv"]) & (rev_deal >= r["landing_rev"]), page)
            .otherwise(rest))


# The simulator's budget slider, -50% .. +50% in steps of 5.
BUDGET_STEPS = [float(x) for x in range(-50, 55, 5)]


def uniform_scenarios(matrix: DataFrame, steps: list[float] | None = None) -> DataFrame:
    """Scenario table for R3: one scenario per slider step, applied to every channel.

    Built by exploding the step list on the channel rows Spark computed, so
    no join: (scenario_id, origin, change_pct).
    """
    st = steps if steps is not None else BUDGET_STEPS
    arr = F.array(*[F.struct(F.lit(i).alias("scenario_id"), F.lit(float(v)).alias("change_pct"))
                    for i, v in enumerate(st)])
    return (matrix.select(F.col("lead_origin").alias("origin"), F.explode(arr).alias("s"))
            .select("s.scenario_id", "origin", "s.change_pct"))


def _project(ch: DataFrame, pct: Column) -> list[Column]:
    base_budget = F.col("total_mqls") * F.col("cac")
    new_budget = base_budget * (F.lit(1.0) + pct / F.lit(100.0))
    new_mqls = F.floor(F.try_divide(new_budget, F.col("cac"))).cast("long")        # int() truncation
    new_deals = F.floor(new_mqls * F.col("conversion_rate")).cast("long")
    return [new_mqls, new_deals]


# channels that may ride with every scenario
MOST_CHANNELS = 10_000


def scenario_projection(matrix: DataFrame, scenarios: DataFrame,
                        cac: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Projected MQLs, deals and revenue per (scenario, channel), and scenario totals.

    ``scenarios`` lists (scenario_id, origin, change_pct).  Every scenario has a
    row for every channel: one that it does not list stays at 0 %, a listed name
    that is no channel is ignored, and of a channel listed twice the larger change
    counts.  Truncation follows the reference, so a 0 % change may move revenue
    by a deal (D14).
    """
    ch = matrix.select(F.col("lead_origin").alias("origin"), "total_mqls", "closed_deals", "conversion_rate",
                       "revenue_per_closed_deal", cac_column("lead_origin", cac).alias("cac"))
    # the channels are one array, a scalar subquery that is computed once (their number is checked)
    if (n := matrix.count()) > MOST_CHANNELS:
        raise ValueError(f"{n} channels; scenarios take at most {MOST_CHANNELS}")
    listed = (scenarios.groupBy("scenario_id", "origin").agg(F.max("change_pct").alias("change_pct"))
              .groupBy("scenario_id").agg(F.map_from_entries(F.collect_list(F.struct("origin", "change_pct"))).alias("changes")))
    grid = matrix.sparkSession.sql(
        "SELECT scenario_id, changes, inline((SELECT collect_list(struct(*)) FROM {ch})) FROM {listed}", ch=ch, listed=listed)
    grid = grid.withColumn("change_pct", F.coalesce(F.try_element_at("changes", F.col("origin")), F.lit(0.0)))
    rd = F.coalesce(F.col("revenue_per_closed_deal"), F.lit(0.0))
    mq, dl = _project(grid, F.col("change_pct"))
    rows = grid.select("scenario_id", "origin", F.col("change_pct").alias("budget_change_pct"),
                       F.col("total_mqls").alias("baseline_mqls"), mq.alias("simulated_mqls"),
                       F.col("closed_deals").alias("baseline_deals"), dl.alias("simulated_deals"),
                       (F.col("closed_deals") * rd).alias("_b"), (dl * rd).alias("_s"))
    totals = rows.groupBy("scenario_id").agg(F.coalesce(F.sum("_b"), F.lit(0.0)).alias("_all_b"),
                                             F.coalesce(F.sum("_s"), F.lit(0.0)).alias("_all_s"))
    totals = totals.select(
        "scenario_id",
        F.round("_all_b", 2).alias("total_baseline_revenue"),
        F.round("_all_s", 2).alias("total_simulated_revenue"),
        F.round(F.col("_all_s") - F.col("_all_b"), 2).alias("net_revenue_delta"),
        F.when(F.col("_all_b") > 0, F.round((F.col("_all_s") - F.col("_all_b")) / F.col("_all_b") * 100, 2))
         .otherwise(F.lit(0.0)).alias("roi_lift_pct"))
    rows = rows.select(
        "scenario_id", "origin", "budget_change_pct", "baseline_mqls", "simulated_mqls",
        "baseline_deals", "simulated_deals",
        F.round("_b", 2).alias("baseline_revenue"), F.round("_s", 2).alias("simulated_revenue"),
        F.round(F.col("_s") - F.col("_b"), 2).alias("revenue_delta"))
    return rows, totals


def channel_rank(matrix: DataFrame) -> DataFrame:
    """Dense rank of revenue per closed deal over all channels."""
    w = Window.orderBy(F.desc(F.coalesce("revenue_per_closed_deal", F.lit(0.0))))
    return matrix.select("lead_origin", F.dense_rank().over(w).cast("int").alias("channel_rank"))
