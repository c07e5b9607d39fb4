"""Scalar Column expressions.

Everything here returns a ``Column`` built from Spark's own functions, so it
stays inside whole-stage codegen; there is no Python UDF anywhere.
ANSI mode is on in Spark 4: every division goes through ``try_divide``.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_label(c: str | Column, default: str = "unknown") -> Column:
    """Missing -> default, then strip and lower-case."""
    return F.lower(F.trim(F.coalesce(col(c), F.lit(default))))


def date_key(ts: str | Column) -> Column:
    """smart date key YYYYMMDD as int (by arithmetic; text only outside the four-digit years)."""
    t = col(ts)
    digits = F.year(t) * 10000 + F.month(t) * 100 + F.dayofmonth(t)
    return F.when(F.year(t).between(1, 9999), digits).otherwise(F.date_format(t, "yyyyMMdd").cast("int"))


def time_of_day(ts: str | Column) -> Column:
    """Microseconds since midnight on the wall clock."""
    t = col(ts)
    return ((F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1_000_000
            + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long"))


def whole_days(later_day: str | Column, later_time: str | Column, earlier_day: str | Column, earlier_time: str | Column) -> Column:
    """F10 from dates and times of day: the days between, one less if the later time of day is the smaller one."""
    return (F.datediff(col(later_day), col(earlier_day))
            - F.when(col(later_time) < col(earlier_time), 1).otherwise(0)).cast("int")


def day_floor(later: str | Column, earlier: str | Column) -> Column:
    """whole elapsed days, floored (a purchase 2 h before signing is -1).

    From calendar days and times of day, so a wall-clock (TIMESTAMP_NTZ) value
    never passes through the session time zone.  NULL when either side is NULL.
    """
    a, b = col(later), col(earlier)
    return whole_days(F.to_date(a), time_of_day(a), F.to_date(b), time_of_day(b))


def month_bucket(days: str | Column, width: int = 30) -> Column:
    """30-day months since signing (days are >= 0 where used)."""
    return F.floor(col(days) / F.lit(width)).cast("int")


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num/den in DOUBLE, NULL when den is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def ratio_or(num: str | Column, den: str | Column, default: float = 0.0) -> Column:
    """DAX DIVIDE(num, den, default)."""
    return F.coalesce(safe_ratio(num, den), F.lit(default))


def z_for(confidence: float) -> float:
    """F8: two-sided normal quantile, computed once on the driver."""
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def wilson(k: str | Column, n: str | Column, z: float = 1.96,
           clamp: bool = False) -> tuple[Column, Column, Column]:
    """Wilson score interval (p, lower, upper) as Columns.

    n = 0 gives (0, 0, 0).  The operation order is fixed so that the DuckDB
    twin in ``leadlens.oracle`` produces bit-identical doubles.
    """
    k, n = col(k), col(n)
    z2 = z * z
    nd = n.cast("double")
    p = F.try_divide(k.cast("double"), nd)
    centre = p + F.try_divide(F.lit(z2), 2 * nd)
    half = F.lit(z) * F.sqrt(F.try_divide(p * (F.lit(1.0) - p) + F.try_divide(F.lit(z2), 4 * nd), nd))
    denom = F.lit(1.0) + F.try_divide(F.lit(z2), nd)
    lo = F.try_divide(centre - half, denom)
    hi = F.try_divide(centre + half, denom)
    if clamp:
        lo = F.greatest(F.lit(0.0), lo)
        hi = F.least(F.lit(1.0), hi)
    zero = F.lit(0.0)
    empty = n.isNull() | (n == 0)
    return (F.when(empty, zero).otherwise(p), F.when(empty, zero).otherwise(lo),
            F.when(empty, zero).otherwise(hi))


def pretty_label(c: str | Column) -> Column:
    """'paid_search' -> 'Paid Search'."""
    return F.initcap(F.regexp_replace(col(c), "_", " "))


def short_id(c: str | Column, n: int = 8) -> Column:
    """ID prefix for display."""
    return F.substring(col(c), 1, n)


def roi_band(roi: str | Column, high: float = 15.0, mid: float = 8.0, low: float = 4.0) -> Column:
    """band a ROI multiple by threshold."""
    r = col(roi)
    return (F.when(r >= high, "excellent").when(r >= mid, "strong")
            .when(r >= low, "moderate").otherwise("weak"))


def pct_text(c: str | Column, digits: int = 1) -> Column:
    """Python '{:.1%}' as text."""
    return F.concat(F.format_number(col(c) * 100, digits), F.lit("%"))


def money_text(c: str | Column, digits: int = 2) -> Column:
    """Python '${:,.2f}' as text."""
    return F.concat(F.lit("$"), F.format_number(col(c), digits))


def count_text(c: str | Column) -> Column:
    """Python '{:,}' as text."""
    return F.format_number(col(c), 0)


def nan_to_null(c: str | Column) -> Column:
    """NaN and +/-Infinity become NULL."""
    x = col(c)
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(x)
