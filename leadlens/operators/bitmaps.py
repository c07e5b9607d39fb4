"""Exact distinct counts and key checks by mergeable bitmaps.

A set of integer keys is kept as rows (word, bits): ``word = key >> 6`` and 64
bits for the keys of that word.  Words of one number are OR-ed (``bit_or``), at
any grain and in any order, and the size of a set is the sum of ``bit_count``.
The word and its bits are plain LONGs, so the partial aggregation runs in the
hash aggregate with generated code; a bitmap in a BINARY buffer would be sorted
first.  Keys numbered densely where their rows lie share words, so a task ships
up to 64 keys a row; keys that are scattered cost one row each, as a plain
distinct would, never more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import BROADCAST_MAX_ROWS

WORD_BITS = 6


def word_of(key: Column) -> Column:
    return F.shiftright(key.cast("long"), WORD_BITS)


def bit_of(key: Column) -> Column:
    """The key's bit in its word (NULL for a NULL key, which no OR takes up)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), key.cast("long").bitwiseAND(F.lit(63)).cast("int"))


def words(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """(by, word, bits): the set of ``key`` of every group; merge with ``merged``."""
    k = F.col(key)
    return df.filter(k.isNotNull()).groupBy(*(by or []), word_of(k).alias("word")).agg(F.bit_or(bit_of(k)).alias("bits"))


def merged(sets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sets OR-ed to the coarser grain ``by``."""
    return sets.groupBy(*(by or []), "word").agg(F.bit_or("bits").alias("bits"))


def sizes(sets: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Number of keys of every group of merged sets."""
    return sets.groupBy(*by).agg(F.sum(F.bit_count("bits")).cast("long").alias(name))


def distinct_counts(df: DataFrame, by: list[str], keys: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per group: the exact distinct counts of several integer keys next to sums, from one scan.

    Every row carries one (key number, word, bit) per key; the first one also
    carries the addends.  The words are aggregated where the rows lie, so what
    is shuffled are words and partial sums, not keys, and no row is multiplied
    by an Expand of the distinct aggregates.
    """
    sums = sums or {}
    names, totals = list(keys), list(sums)
    # word 0 stands for "no key": its bits are NULL, and a first row without a key still brings its addends
    parts = F.array(*[F.struct(F.lit(i).alias("which"), F.coalesce(word_of(k), F.lit(0).cast("long")).alias("word"), bit_of(k).alias("bit"))
                      for i, k in enumerate(keys.values())])
    addends = [c.alias(f"_s{i}") for i, c in enumerate(sums.values())]
    rows = df.select(*by, *addends, F.explode(parts).alias("_k")).select(*by, *[f"_s{i}" for i in range(len(totals))], "_k.*")
    first = F.col("which") == 0
    partial = rows.groupBy(*by, "which", "word").agg(
        F.bit_or("bit").alias("bits"), *[F.sum(F.when(first, F.col(f"_s{i}"))).alias(f"_s{i}") for i in range(len(totals))])
    return partial.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("which") == i, F.bit_count("bits"))), F.lit(0)).cast("long").alias(n) for i, n in enumerate(names)],
        *[F.sum(f"_s{i}").alias(n) for i, n in enumerate(totals)])


def membership(df: DataFrame, checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``df`` with one BOOLEAN per (column, parent, flag): whether the parent's set of ``key`` holds the
    column's value (NULL stays NULL).  Parents come as (word, bits), whose words are unique, so a
    child row is never repeated; they are shipped, which a caller allows by counting them."""
    if not checks:
        return df
    # one statement, so the joins are analysed once
    sides = {f"p{i}": parent for i, (_, parent, _) in enumerate(checks)}
    joins = " ".join(f"LEFT JOIN {{p{i}}} s{i} ON shiftright(CAST(t.`{c}` AS BIGINT), {WORD_BITS}) = s{i}.word" for i, (c, _, _) in enumerate(checks))
    flags = ", ".join(f"CASE WHEN t.`{c}` IS NOT NULL THEN coalesce(s{i}.bits & shiftleft(1L, CAST(t.`{c}` & 63 AS INT)) <> 0, false) END AS `{flag}`"
                      for i, (c, _, flag) in enumerate(checks))
    hint = ", ".join(f"s{i}" for i in range(len(checks)))
    return df.sparkSession.sql(f"SELECT /*+ BROADCAST({hint}) */ t.*, {flags} FROM {{t}} t {joins}", t=df, **sides)


def ships(rows: int | None, sets: Callable[[], DataFrame], bound: int = BROADCAST_MAX_ROWS) -> bool:
    """Whether a parent's words may be broadcast: known from its rows, else counted."""
    return (rows is not None and rows <= bound) or sets().count() <= bound
