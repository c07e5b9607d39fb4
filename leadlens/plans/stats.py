"""Statistics over channels.

Nothing here windows or collects raw fact rows: leads are first reduced to
(channel, value) histograms, whose size is bounded by channels x distinct
day values, and those small tables carry the running sums.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf_col
from ..operators.joins import broadcast_if
from ..operators.keys import dense_key
from ..operators.partitioning import spread
from .warehouse import Warehouse

HASH_BITS = 60         # of an md5 that a draw or weight uses (15 hex digits)
DRAW_CHUNK = 100_000   # bootstrap draws generated from one row
BROADCAST_DEALS = 16_000_000   # deals of the bootstrap, a key and an amount each, that may be shipped to every task


# ---------------------------------------------------------------- T3 chi-square
def _chi_terms(wh: Warehouse) -> DataFrame:
    c = (wh["fact_lead"].join(wh.dim("dim_origin"), "origin_key")
         .groupBy("origin_name").agg(F.count(F.lit(1)).alias("n"), F.sum("is_won").alias("k")))
    every = Window.partitionBy()            # one row per channel
    c = c.select("*", F.sum("n").over(every).alias("n_tot"), F.sum("k").over(every).alias("k_tot"),
                 F.count(F.lit(1)).over(every).alias("r"))
    n, k, N, K = (F.col(x).cast("double") for x in ("n", "k", "n_tot", "k_tot"))
    e1 = n * K / N
    e0 = n * (N - K) / N

    def dev(o, e):
        d = F.abs(o - e)
        return F.when(F.col("r") == 2, d - F.least(F.lit(0.5), d)).otherwise(d)   # Yates when dof = 1
    term = F.pow(dev(k, e1), 2) / e1 + F.pow(dev(n - k, e0), 2) / e0
    return c.select("origin_name", "r", "n_tot", term.alias("term"))


def chi_square(wh: Warehouse, with_p: bool = False) -> DataFrame:
    """Chi-square test of origin x won: statistic, dof, Cramer's V (+ p, significance)."""
    t = _chi_terms(wh).agg(F.sum("term").alias("chi2"), F.max("r").alias("r"), F.max("n_tot").alias("n_tot"))
    out = t.select(
        F.round("chi2", 3).alias("chi2_stat"),
        (F.col("r") - 1).cast("int").alias("degrees_of_freedom"),
        F.round(F.sqrt(F.try_divide(F.col("chi2"), F.col("n_tot") * (F.least(F.col("r"), F.lit(2)) - 1))), 4).alias("cramers_v"),
        F.col("chi2").alias("_chi2"))
    if with_p:
        p = chi2_sf_col(F.col("_chi2"), F.col("degrees_of_freedom"))
        out = out.withColumn("p_value", F.round(p, 9)).withColumn("is_statistically_significant", F.col("p_value") < 0.05)
    return out.drop("_chi2")


# ---------------------------------------------------------------- T4 Kaplan-Meier
def _durations(wh: Warehouse) -> tuple[DataFrame, int]:
    """(origin, duration, event); unwon leads censored at the global max days_to_close (90 if none)."""
    mx = wh.scalar("max_days_to_close", lambda: wh["fact_lead"].agg(F.max("days_to_close")).first()[0])
    max_days = int(mx) if mx is not None else 90
    d = (wh["fact_lead"].join(wh.dim("dim_origin"), "origin_key")
         .select(F.col("origin_name").alias("origin"),
                 F.coalesce("days_to_close", F.lit(max_days)).alias("t"),
                 F.col("is_won").alias("e")))
    return d, max_days


def _hist(durations: DataFrame) -> DataFrame:
    return durations.groupBy("origin", "t").agg(F.sum("e").cast("long").alias("d"),
                                                F.count(F.lit(1)).alias("m"))


def _shared_hist(wh: Warehouse) -> DataFrame:
    """The (channel, day) histogram of all survival analyses, written once per warehouse."""
    return wh.derived("survival_histogram", lambda: _hist(_durations(wh)[0]), aggregated=True)


def km_curve(wh: Warehouse) -> DataFrame:
    """T4: textbook Kaplan-Meier per origin (fixes D1): at risk = durations >= t."""
    h = _shared_hist(wh)
    back = Window.partitionBy("origin").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    fwd = Window.partitionBy("origin").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("n_at_risk", F.sum("m").over(back))
    h = h.withColumn("survival", F.product(F.lit(1.0) - F.col("d") / F.col("n_at_risk")).over(fwd))
    return h.select("origin", F.col("t").alias("time"), "n_at_risk", F.col("d").alias("events"),
                    (F.col("m") - F.col("d")).alias("censored"), "survival")


def km_curve_rounded(wh: Warehouse) -> DataFrame:
    return km_curve(wh).withColumn("survival", F.round("survival", 4))


def km_curve_from_start(wh: Warehouse) -> DataFrame:
    """T4: the rounded curve of each channel behind its start row, survival 1.0 at time 0."""
    c = km_curve_rounded(wh)
    start = c.groupBy("origin").agg(F.max("n_at_risk").alias("n_at_risk")).select(
        "origin", F.lit(0).cast(c.schema["time"].dataType).alias("time"), "n_at_risk", F.lit(0).cast("long").alias("events"),
        F.lit(0).cast("long").alias("censored"), F.lit(1.0).alias("survival"), F.lit(0).alias("step"))
    return start.unionByName(c.withColumn("step", F.lit(1)))


def km_median(wh: Warehouse) -> DataFrame:
    """T4: first time with S(t) <= 0.5, else the censoring horizon."""
    _, max_days = _durations(wh)
    c = km_curve(wh)
    return c.groupBy("origin").agg(
        # S(t) is a running product of doubles; compare at 12 places so an exact 0.5 stays 0.5
        F.coalesce(F.min(F.when(F.round("survival", 12) <= 0.5, F.col("time"))), F.lit(max_days)).cast("int")
        .alias("median_days"))


# ---------------------------------------------------------------- T5 log-rank
def _risk_grid(wh: Warehouse) -> DataFrame:
    """(origin, t, n_g, d_g) at every event time t of the pooled sample.

    n_g(t) is constant between two consecutive durations of a group, so each
    histogram row spreads its at-risk count over the integer days since the
    group's previous duration (``sequence``), then an equi-join keeps only
    event times.  Rows are bounded by channels x day range, not by leads.
    """
    h = _shared_hist(wh)
    lo = wh.scalar("min_duration", lambda: h.agg(F.min("t")).first()[0])
    back = Window.partitionBy("origin").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    prev = Window.partitionBy("origin").orderBy("t")
    h = (h.withColumn("n_g", F.sum("m").over(back))
          .withColumn("prev", F.coalesce(F.lag("t").over(prev), F.lit(lo - 1))))
    daily = h.select("origin", "n_g", "t", "d",
                     F.explode(F.sequence(F.col("prev") + 1, F.col("t"))).alias("u"))
    daily = daily.select("origin", F.col("u").alias("t"), "n_g",
                         F.when(F.col("u") == F.col("t"), F.col("d")).otherwise(F.lit(0)).alias("d_g"))
    events = h.groupBy("t").agg(F.sum("d").alias("_d")).filter(F.col("_d") > 0).select("t")
    return daily.join(events, "t")


def logrank_pairwise(wh: Warehouse) -> DataFrame:
    """T5: two-sample log-rank chi-square for every pair of channels (dof 1)."""
    g = _risk_grid(wh)
    a = g.select(F.col("origin").alias("origin_a"), "t", F.col("n_g").alias("na"), F.col("d_g").alias("da"))
    b = g.select(F.col("origin").alias("origin_b"), "t", F.col("n_g").alias("nb"), F.col("d_g").alias("db"))
    p = a.join(b, "t").filter(F.col("origin_a") < F.col("origin_b"))
    n = (F.col("na") + F.col("nb")).cast("double")
    d = (F.col("da") + F.col("db")).cast("double")
    frac = F.col("na") / n
    p = p.filter(d > 0).select(
        "origin_a", "origin_b",
        (F.col("da") - d * frac).alias("oe"),
        F.when(n > 1, d * frac * (F.lit(1.0) - frac) * (n - d) / (n - 1)).otherwise(F.lit(0.0)).alias("v"))
    s = p.groupBy("origin_a", "origin_b").agg(F.sum("oe").alias("oe"), F.sum("v").alias("v"))
    return s.select("origin_a", "origin_b", F.round(F.try_divide(F.col("oe") * F.col("oe"), F.col("v")), 4)
                    .alias("chi2_stat"))


def logrank_components(wh: Warehouse, digits: int | None = 6) -> DataFrame:
    """T5 (fixes D2): the terms of the k-sample log-rank statistic in long form.

    One row per pair of channels (origin_a <= origin_b): ``v`` is the covariance
    of the two channels' observed minus expected events, ``z`` their own excess
    (on the diagonal).  The statistic is z' V^-1 z over all channels but one
    (``logrank_k``).  ``digits`` rounds the terms, None leaves them as they are.
    """
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    g = _risk_grid(wh)
    tot = g.groupBy("t").agg(F.sum("n_g").alias("n"), F.sum("d_g").alias("d"))
    g = g.join(tot, "t").withColumn("a", F.col("n_g") / F.col("n")).withColumn(
        "w", F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(F.lit(0.0)))
    g = wh.derived("logrank_grid", lambda: g.select("origin", "t", "a", "w", (F.col("d_g") - F.col("d") * F.col("a")).alias("x")),
                   aggregated=True)
    left = g.select("t", "w", "x", F.col("origin").alias("origin_a"), F.col("a").alias("ai"))
    right = g.select("t", F.col("origin").alias("origin_b"), F.col("a").alias("aj"))
    same = F.col("origin_a") == F.col("origin_b")
    return (left.join(right, (left.t == right.t) & (F.col("origin_a") <= F.col("origin_b")))
            .groupBy("origin_a", "origin_b")
            .agg(shown(F.sum(F.when(same, F.col("x")))).alias("z"),
                 shown(F.sum(F.col("w") * F.col("ai") * (F.when(same, 1.0).otherwise(0.0) - F.col("aj")))).alias("v")))


def logrank_k(wh: Warehouse) -> DataFrame:
    """T5: the k-sample log-rank statistic over all channels, its degrees of freedom and p-value.

    The covariance matrix of all channels but the last and the excess vector z are one array of
    rows [V | z] (at most channels squared numbers).  Elimination runs down its pivots inside one
    ``aggregate``: after the steps before it, pivot d and its right-hand side e add e^2 / d to
    z' V^-1 z.  A pivot of (nearly) nothing - a channel whose leads leave the risk set at once -
    adds neither to the statistic nor to the degrees of freedom.
    """
    terms = logrank_components(wh, digits=None)
    both = terms.select(F.col("origin_a").alias("r"), F.col("origin_b").alias("c"), "v", "z").unionByName(
        terms.filter("origin_a <> origin_b").select(F.col("origin_b").alias("r"), F.col("origin_a").alias("c"), "v", F.lit(None).cast("double").alias("z")))
    rows = both.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("cells"), F.max("z").alias("z"))
    system = rows.agg(F.array_sort(F.collect_list(F.struct("r", "cells", "z"))).alias("rows"))
    k = F.size("rows")
    # all channels but the last, each row with its excess behind it
    matrix = F.transform(F.slice("rows", 1, F.greatest(k - 1, F.lit(0))), lambda r: F.concat(
        F.transform(F.slice(r["cells"], 1, F.greatest(k - 1, F.lit(0))), lambda c: c["v"]), F.array(r["z"])))
    start = F.struct(F.col("m").alias("m"), F.lit(0.0).alias("chi2"), F.lit(0).alias("dof"))

    def step(s: Column, i: Column) -> Column:
        pivot = F.get(s["m"], i)
        d, e = F.get(pivot, i), F.element_at(pivot, -1)
        sound = d > 1e-9
        cleared = F.transform(s["m"], lambda row, j: F.when((j > i) & sound, F.zip_with(
            row, pivot, lambda x, y: x - F.get(row, i) / d * y)).otherwise(row))
        return F.struct(cleared.alias("m"), (s["chi2"] + F.when(sound, e * e / d).otherwise(0.0)).alias("chi2"),
                        (s["dof"] + F.when(sound, 1).otherwise(0)).alias("dof"))

    solved = system.select(matrix.alias("m")).filter(F.size("m") > 0).select(
        F.aggregate(F.sequence(F.lit(0), F.size("m") - 1), start, step).alias("s"))
    p = chi2_sf_col(F.col("s.chi2"), F.col("s.dof"))
    return solved.select(F.round("s.chi2", 4).alias("chi2_stat"), F.col("s.dof").alias("degrees_of_freedom"),
                         F.round(p, 9).alias("p_value"), (p < 0.05).alias("is_statistically_significant"))


# ---------------------------------------------------------------- T6/T7 deals with revenue
def deals_with_revenue(wh: Warehouse) -> DataFrame:
    """Won leads with channel, segment and post-signing revenue of their seller (0 if none).

    Canceled items are kept, as in the reference's bootstrap and heat map.
    Shared by the bootstraps and the heat map: written once per warehouse.
    """
    return wh.derived("deals_with_revenue", lambda: _deals_with_revenue(wh), aggregated=False)


def _deals_with_revenue(wh: Warehouse) -> DataFrame:
    rev = (wh["fact_order_item"].filter(F.col("days_after_won") >= 0)
           .groupBy("seller_key").agg(F.sum("price").alias("rev")))
    return (wh["fact_lead"].filter(F.col("is_won") == 1)
            .join(wh.dim("dim_origin"), "origin_key").join(wh.dim("dim_segment"), "segment_key")
            .join(rev, "seller_key", "left")
            .select("lead_key", F.col("origin_name").alias("origin"), F.col("segment_name").alias("segment"),
                    F.coalesce(F.col("rev").cast("double"), F.lit(0.0)).alias("total_revenue")))


def bootstrap_ci(wh: Warehouse, reps: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """T6 (fixes D13): seeded bootstrap CI of mean revenue per deal, by channel.

    Draw j of replicate r in channel o picks deal number
    1 + (first 60 bits of md5('seed|o|r|j') mod n).  Deals are numbered 1..n
    inside each channel from a global dense key (no per-channel window over
    fact rows), draws are generated by ``sequence`` per (channel, replicate)
    and resolved by an equi-join on that key; n <= 2 gives a degenerate interval.
    """
    deals = deals_with_revenue(wh)
    keyed, n_deals = dense_key(deals, ["origin", "lead_key"], "_gk", name="bootstrap")
    first = keyed.groupBy("origin").agg(F.min("_gk").alias("_g0"), F.count(F.lit(1)).alias("n"),
                                        F.avg("total_revenue").alias("mean"))
    boot_groups = first.filter(F.col("n") > 2).select("origin", "_g0", "n")
    # One row per (channel, replicate, chunk of at most DRAW_CHUNK draws): a
    # channel holding most deals spreads its draws over many tasks.  The
    # explicit partition count keeps AQE from coalescing these few, small
    # rows into a single task before they expand.
    chunk = F.lit(DRAW_CHUNK).cast("long")
    work = boot_groups.select("origin", "_g0", "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    work = work.select("origin", "_g0", "n", "rep",
                       F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("c"))
    work = work.repartition(wh.spark.sparkContext.defaultParallelism, "origin", "rep", "c")
    draws = work.select("origin", "rep", "_g0", "n", F.explode(F.sequence(
        F.col("c") * chunk + 1, F.least((F.col("c") + 1) * chunk, F.col("n")))).alias("j"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("origin"), F.col("rep").cast("string"),
                                             F.col("j").cast("string"))), 1, HASH_BITS // 4), 16, 10).cast("long")
    # a channel's deals lie one after the other from its first global key
    draws = draws.select("origin", "rep", (F.col("_g0") + h % F.col("n")).alias("_gk"))
    # deals are few enough (checked count) to ship to every task, as (key, amount) alone: draws are
    # then resolved where they are generated and only (channel, replicate) partials shuffle
    means = (draws.join(broadcast_if(keyed.select("_gk", "total_revenue"), n_deals, BROADCAST_DEALS), "_gk")
             .groupBy("origin", "rep").agg(F.avg("total_revenue").alias("m")))
    ci = means.groupBy("origin").agg(
        F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    out = first.join(ci, "origin", "left")
    return out.select(
        "origin", F.col("n").alias("closed_deals"),
        F.round("mean", 2).alias("mean_revenue_per_deal"),
        F.round(F.when(F.col("n") > 2, F.col("lo")).otherwise(F.col("mean")), 2).alias("boot_ci_lower"),
        F.round(F.when(F.col("n") > 2, F.col("hi")).otherwise(F.col("mean")), 2).alias("boot_ci_upper"),
    ).orderBy(F.desc("mean_revenue_per_deal"))


def _poisson_thresholds() -> list[int]:
    """floor(2^60 P(W <= w)) of Poisson(1) for all w below the hash's resolution: what lies
    beyond the last has a probability of less than 2^-60, so no weight is cut."""
    term = Fraction(1)
    e = sum((term := term / k) if k else term for k in range(40))   # exact to far below 2^-60
    out, term, total = [], Fraction(1), Fraction(0)
    for w in range(40):
        term = term / w if w else term
        total += term
        level = int(total / e * (1 << HASH_BITS))
        if level >= (1 << HASH_BITS) - 1:
            break
        out.append(level)
    return out


POISSON1 = _poisson_thresholds()


def bootstrap_ci_poisson(wh: Warehouse, reps: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """T6 at scale: Poisson(1) bootstrap; each deal row carries its own weight per replicate.

    No numbering and no join: every row explodes its replicates, the weight
    comes from a hash of (seed, deal, replicate), and weighted sums are
    partially aggregated, so only reps x channels rows are shuffled.
    """
    deals = spread(deals_with_revenue(wh))          # each row becomes `reps` rows below
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("lead_key").cast("string"),
                                                F.col("rep").cast("string"))), 1, HASH_BITS // 4), 16, 10).cast("long")
    w = sum((F.when(h >= F.lit(level).cast("long"), 1).otherwise(0) for level in POISSON1), F.lit(0))
    x = deals.select("origin", "lead_key", "total_revenue", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    x = x.select("origin", "rep", "total_revenue", w.alias("w"))
    means = x.groupBy("origin", "rep").agg(
        F.try_divide(F.sum(F.col("w") * F.col("total_revenue")), F.sum("w").cast("double")).alias("m"))
    ci = means.groupBy("origin").agg(
        F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    base = deals.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.avg("total_revenue").alias("mean"))
    return base.join(ci, "origin", "left").select(
        "origin", F.col("n").alias("closed_deals"), F.round("mean", 2).alias("mean_revenue_per_deal"),
        F.round(F.when(F.col("n") > 2, F.col("lo")).otherwise(F.col("mean")), 2).alias("boot_ci_lower"),
        F.round(F.when(F.col("n") > 2, F.col("hi")).otherwise(F.col("mean")), 2).alias("boot_ci_upper"))


SPLIT_CHUNK = 20_000   # deals that one group of the split bootstrap resamples


def replicate_sums(sizes: dict[str, int], reps: int, seed: int, chunk: int):
    """A function over the deals (origin, c, total_revenue) of one chunk: (origin, rep, total), the sum of
    the chunk's resampled deals in every replicate.

    A replicate draws n of a channel's n deals with replacement.  How many of its draws fall
    on a chunk is found by halving the range of chunks: the draws of a range fall on its left
    half with a binomial whose seed is the range, so every chunk finds the same split without
    being told.  Inside, conditional binomials run over the chunk's distinct amounts, all
    replicates at once.  The counts are exactly multinomial, and no draw is ever made singly.
    """
    def run(key, frame):
        import zlib

        import numpy as np
        import pandas as pd
        origin, c = str(key[0]), int(key[1])
        n = sizes[origin]
        last = -(-n // chunk)
        draws = lambda *place: np.random.default_rng([seed, zlib.crc32(origin.encode()), *place])
        m, lo, hi = np.full(reps, n), 0, last
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = draws(0, lo, hi).binomial(m, (mid - lo) * chunk / (min(hi * chunk, n) - lo * chunk))
            m, lo, hi = (left, lo, mid) if c < mid else (m - left, mid, hi)
        amounts, copies = np.unique(frame["total_revenue"].to_numpy(), return_counts=True)
        total, rest, rng = np.zeros(reps), int(copies.sum()), draws(1, c, c)
        for amount, k in zip(amounts, copies):
            taken = m if k == rest else rng.binomial(m, k / rest)
            total += taken * amount
            m, rest = m - taken, rest - k
        return pd.DataFrame({"origin": origin, "rep": np.arange(reps, dtype=np.int32), "total": total})

    return run


def bootstrap_ci_split(wh: Warehouse, reps: int = 1000, seed: int = 42, alpha: float = 0.05, chunk: int = SPLIT_CHUNK) -> DataFrame:
    """T6 exact at scale: multinomial resampling without one row per draw or replicate of a deal.

    Deals are numbered and cut into chunks; a chunk's part of every replicate is one binomial
    split (``replicate_sums``).  What is shuffled are the deals once, and replicates x channels
    partial sums."""
    keyed, _ = dense_key(deals_with_revenue(wh), ["origin", "lead_key"], "_gk", name="bootstrap_split")
    first = keyed.groupBy("origin").agg(F.min("_gk").alias("_g0"), F.count(F.lit(1)).alias("n"), F.avg("total_revenue").alias("mean"))
    sizes = {r["origin"]: r["n"] for r in first.select("origin", "n").collect()}       # one number per channel
    chunks = keyed.join(F.broadcast(first.select("origin", "_g0")), "origin").select(
        "origin", F.floor((F.col("_gk") - F.col("_g0")) / chunk).cast("long").alias("c"), "total_revenue")
    sums = chunks.groupBy("origin", "c").applyInPandas(replicate_sums(sizes, reps, seed, chunk), "origin string, rep int, total double")
    means = (sums.groupBy("origin", "rep").agg(F.sum("total").alias("total")).join(F.broadcast(first.select("origin", "n")), "origin")
             .select("origin", (F.col("total") / F.col("n")).alias("m")))
    ci = means.groupBy("origin").agg(
        F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    return first.join(ci, "origin", "left").select(
        "origin", F.col("n").alias("closed_deals"), F.round("mean", 2).alias("mean_revenue_per_deal"),
        F.round(F.when(F.col("n") > 2, F.col("lo")).otherwise(F.col("mean")), 2).alias("boot_ci_lower"),
        F.round(F.when(F.col("n") > 2, F.col("hi")).otherwise(F.col("mean")), 2).alias("boot_ci_upper"))


def heatmap(wh: Warehouse, min_n: int = 10) -> DataFrame:
    """Segment x origin revenue per deal, cells with n < 10 suppressed."""
    d = deals_with_revenue(wh)
    g = d.groupBy(F.col("segment").alias("segment_name"), F.col("origin").alias("origin_name")).agg(
        F.count(F.lit(1)).alias("n_deals"), F.sum("total_revenue").alias("total_rev"),
        F.avg("total_revenue").alias("avg_rev"))
    return g.select("segment_name", "origin_name", "n_deals", F.round("total_rev", 2).alias("total_rev"),
                    F.round("avg_rev", 2).alias("avg_rev"),
                    (F.col("n_deals") < min_n).alias("suppressed"),
                    F.when(F.col("n_deals") >= min_n, F.round("avg_rev", 2)).alias("display_avg_rev"))


def heatmap_pivot(wh: Warehouse, min_n: int = 10) -> DataFrame:
    """T7/A14 wide form: one row per segment, one column per channel (dim_origin names)."""
    names = [r[0] for r in wh["dim_origin"].select("origin_name").orderBy("origin_name").collect()]
    return (heatmap(wh, min_n).groupBy("segment_name").pivot("origin_name", names)
            .agg(F.first("display_avg_rev")))


