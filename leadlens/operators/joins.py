"""Join operators.

Broadcast is only ever applied behind a row-count check; beyond the bound
the join stays a shuffle join that AQE may still convert at runtime, and
AQE's skew-join splitting handles a hot key in the shuffle form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows a dimension may have and still be shipped to every task.
BROADCAST_MAX_ROWS = 2_000_000


def broadcast_if(df: DataFrame, rows: int | None, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only when the known row count is within the bound."""
    if rows is not None and rows <= max_rows:
        return F.broadcast(df)
    return df


def left_join_on_predicate(left: DataFrame, right: DataFrame, on: str | list[str],
                           right_filter: Column) -> DataFrame:
    """``LEFT JOIN r ON l.k = r.k AND <pred on r>``: the predicate filters the
    right side before the join, so unmatched left rows survive (not a WHERE)."""
    return left.join(right.filter(right_filter), on=on, how="left")


def or_join(left: DataFrame, right: DataFrame, arm1: tuple[str, str], arm2: tuple[str, str] | None,
            select: list[Column], left_alias: str = "l", right_alias: str = "r") -> DataFrame:
    """Inner join on ``l.a1 = r.b1 OR l.a2 = r.b2`` without a cartesian product.

    Pairs matched by the first equi-arm, plus pairs matched only by the second
    (the first arm is NULL or false for them); each pair appears once.
    ``select`` names the output columns via the two aliases.  Without ``arm2`` it is
    the first arm alone, for keys that the second can never match (D5).
    """
    lft, rgt = left.alias(left_alias), right.alias(right_alias)
    a1 = F.col(f"{left_alias}.{arm1[0]}") == F.col(f"{right_alias}.{arm1[1]}")
    if arm2 is None:
        return lft.join(rgt, a1, "inner").select(*select)
    a2 = F.col(f"{left_alias}.{arm2[0]}") == F.col(f"{right_alias}.{arm2[1]}")
    first = lft.join(rgt, a1, "inner").select(*select)
    second = lft.join(rgt, a2 & ~F.coalesce(a1, F.lit(False)), "inner").select(*select)
    return first.unionByName(second)


def semi(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of left whose key exists in right (EXISTS / isin)."""
    return left.join(right, on=on, how="left_semi")


def anti(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of left whose key is absent from right (NOT EXISTS)."""
    return left.join(right, on=on, how="left_anti")
