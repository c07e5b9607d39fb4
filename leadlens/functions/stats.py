"""Chi-square upper tail as a Column, for rows already aggregated."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# beyond this half-statistic the tail is 0 at nine places for any number of channels below it
_LARGE = 600.0


def chi2_sf_col(x: Column, dof: Column) -> Column:
    """P(X >= x): one minus the series of the regularised lower incomplete gamma function.

    The terms h^n / ((a+1)..(a+n)) come from ``aggregate`` over a sequence, and
    gamma(a+1) of a half-integer a is a sum of logarithms.
    """
    h, k = x.cast("double") / 2, dof.cast("double")
    a = k / 2
    zero = F.lit(0.0)
    # ln gamma(a + 1) = sum of ln(a - i) down to 1, or down to 1/2 times sqrt(pi)
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(a).cast("int") - 1, F.lit(0)))
    log_gamma = F.aggregate(steps, zero, lambda s, i: s + F.log(a - i)) + F.when(k % 2 == 1, math.log(math.pi) / 2).otherwise(zero)
    terms = F.sequence(F.lit(1), (2 * h + 2 * a).cast("int") + 100)
    start = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"))
    series = F.aggregate(terms, start, lambda c, n: F.struct((c["s"] + c["t"] * h / (a + n)).alias("s"),
                                                             (c["t"] * h / (a + n)).alias("t")))["s"]
    lower = F.exp(a * F.log(h) - h - log_gamma) * series
    return (F.when(x.isNull() | F.isnan(x.cast("double")) | dof.isNull() | (dof <= 0), None)
            .when(h <= 0, 1.0).when((h > _LARGE) & (h > 4 * a), 0.0)
            .otherwise(F.greatest(zero, F.lit(1.0) - lower)))
