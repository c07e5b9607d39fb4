"""Data audit and reconciliation.

Each check is an aggregate over whole tables; results are tiny frames.
Counts come back as BIGINT, the activation percentage as DOUBLE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import duplicate_count, null_counts
from ..operators.bitmaps import bit_of, membership, ships, word_of, words
from .warehouse import ITEM_REASONS, Warehouse


def _metric(df: DataFrame, name: str, value) -> DataFrame:
    """A one-row aggregate as a (metric, value) row."""
    return df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")


def audit_totals(wh: Warehouse) -> DataFrame:
    """Q1: row totals of the two lead inputs, long form."""
    r = wh.raw
    one = F.count(F.lit(1))
    return _metric(r["mql"], "total_mqls", one).unionByName(_metric(r["closed_deals"], "total_closed_deals", one))


def audit_dups(wh: Warehouse) -> DataFrame:
    """Duplicated mql_id (leads, deals) and seller_id (deals); NULLs count as equal."""
    r = wh.raw
    parts = [(r["mql"], ["mql_id"], "mql_duplicates"), (r["closed_deals"], ["mql_id"], "closed_mql_duplicates"),
             (r["closed_deals"], ["seller_id"], "seller_id_duplicates")]
    return reduce(DataFrame.unionByName, [
        duplicate_count(df, keys).select(F.lit(name).alias("metric"), F.col("duplicates").alias("value"))
        for df, keys, name in parts])


def audit_nulls(wh: Warehouse) -> DataFrame:
    """NULLs per column of the lead inputs, long form (all columns reported)."""
    r = wh.raw
    return null_counts(r["mql"], "mql").unionByName(null_counts(r["closed_deals"], "closed_deals"))


def audit_date_sanity(wh: Warehouse) -> DataFrame:
    """Deals signed before the lead's first contact."""
    r = wh.raw
    j = r["mql"].select("mql_id", "first_contact_date").join(r["closed_deals"].select("mql_id", "won_date"), "mql_id")
    return _metric(j, "date_sanity_violations", F.count(F.when(F.col("won_date") < F.col("first_contact_date"), 1)))


def audit_orphans(wh: Warehouse) -> DataFrame:
    """Distinct deal mql_ids with no lead (set difference)."""
    r = wh.raw
    diff = r["closed_deals"].select("mql_id").distinct().join(r["mql"].select("mql_id"), "mql_id", "left_anti")
    return _metric(diff, "orphan_closed_mqls", F.count(F.lit(1)))


def audit_activation(wh: Warehouse) -> DataFrame:
    """Signed sellers with any order item (any date, D16) and the share in %."""
    r = wh.raw
    closed = r["closed_deals"].select("seller_id").filter(F.col("seller_id").isNotNull()).distinct()
    sold = r["order_items"].select("seller_id").distinct().withColumn("_hit", F.lit(1))
    t = closed.join(sold, "seller_id", "left").agg(
        F.count(F.lit(1)).alias("closed_sellers_count"), F.count("_hit").alias("closed_sellers_with_orders"))
    return t.select(
        "closed_sellers_count", "closed_sellers_with_orders",
        F.when(F.col("closed_sellers_count") > 0,
               F.round(F.col("closed_sellers_with_orders") / F.col("closed_sellers_count") * 100, 2))
         .otherwise(F.lit(0.0)).alias("activation_rate_pct"))


# The declared constraints of the warehouse schema.
_PK = [("dim_origin", "origin_key"), ("dim_origin", "origin_name"), ("dim_landing_page", "landing_page_key"),
       ("dim_landing_page", "landing_page_id"), ("dim_segment", "segment_key"), ("dim_segment", "segment_name"),
       ("dim_sdr", "sdr_key"), ("dim_sr", "sr_key"), ("dim_date", "date_key"), ("dim_customer", "customer_key"),
       ("dim_customer", "customer_id"), ("dim_product", "product_key"), ("dim_product", "product_id"),
       ("dim_seller", "seller_key"), ("dim_seller", "seller_id"), ("fact_lead", "lead_key"),
       ("fact_lead", "mql_id"), ("fact_order_item", "order_item_key")]
_UNIQUE = [(t, [c]) for t, c in _PK]
_FK = [("fact_lead", "date_key_first_contact", "dim_date", "date_key"),
       ("fact_lead", "origin_key", "dim_origin", "origin_key"),
       ("fact_lead", "landing_page_key", "dim_landing_page", "landing_page_key"),
       ("fact_lead", "date_key_won", "dim_date", "date_key"),
       ("fact_lead", "seller_key", "dim_seller", "seller_key"),
       ("fact_lead", "segment_key", "dim_segment", "segment_key"),
       ("fact_lead", "sdr_key", "dim_sdr", "sdr_key"),
       ("fact_lead", "sr_key", "dim_sr", "sr_key"),
       ("fact_order_item", "date_key_purchase", "dim_date", "date_key"),
       ("fact_order_item", "seller_key", "dim_seller", "seller_key"),
       ("fact_order_item", "product_key", "dim_product", "product_key"),
       ("fact_order_item", "customer_key", "dim_customer", "customer_key")]
_NOT_NULL = [("fact_lead", "mql_id"), ("fact_lead", "origin_key"), ("fact_lead", "is_won"),
             ("fact_order_item", "order_id"), ("fact_order_item", "seller_key"), ("fact_order_item", "price")]
_CHECK = [("fact_lead", "is_won IN (0, 1)"), ("fact_order_item", "price >= 0"),
          ("fact_order_item", "freight_value >= 0"),
          ("fact_order_item", "review_score IS NULL OR review_score BETWEEN 1 AND 5")]


_NATURAL = {"fact_order_item": ["order_id", "order_item_id"]}


def _table_checks(wh: Warehouse, table: str) -> DataFrame:
    """Every declared constraint of one table from one scan of it.

    FOREIGN KEY: the parent's keys are a bitmap, 64 keys a row, and a child row tests its
    bit; a miss is a non-NULL key whose bit is not set (parents whose words are too many to
    ship are counted by ``_large_key_misses``).  UNIQUE: rows minus the size of the set of keys,
    a bitmap for integer keys (NULLs count as one key, as in GROUP BY).  NOT NULL / CHECK:
    conditional counts.
    """
    fks = [(c, d, k) for t, c, d, k in _FK if t == table and _ships(wh, d, k)]
    df = membership(wh[table], [(c, _parent_words(wh, d, k), f"_hit{i}") for i, (c, d, k) in enumerate(fks)])
    tests = [(f"fk:{c}->{d}", f"NOT _hit{i}") for i, (c, d, _) in enumerate(fks)]
    tests += [(f"not_null:{c}", f"{c} IS NULL") for t, c in _NOT_NULL if t == table]
    tests += [(f"check:{cond}", f"NOT ({cond})") for t, cond in _CHECK if t == table]
    flags = "".join(f", CAST(CASE WHEN {test} THEN 1 ELSE 0 END AS BIGINT) AS _c{i}" for i, (_, test) in enumerate(tests))
    adds = "".join(f", sum(_c{i}) AS _c{i}" for i in range(len(tests)))
    keys = [c for t, cols in _UNIQUE if t == table for c in cols]
    if table in _NATURAL:
        # one integer key, and a natural key by which the table is clustered: only words are shuffled.
        # The natural key counts duplicated keys, not extra rows
        natural, (key,) = ", ".join(_NATURAL[table]), keys
        place = f"OVER (PARTITION BY {natural} ORDER BY word"
        parts = f"""
            SELECT 0 AS which, word, bit_or(bits) AS bits, sum(n) AS n,
                   sum(CASE WHEN place = 1 AND total > 1 THEN 1 ELSE 0 END) AS twice{adds}
            FROM (SELECT *, row_number() {place}) AS place,
                         sum(n) {place} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total
                  FROM (SELECT {natural}, shiftright({key}, 6) AS word, bit_or(shiftleft(1L, CAST({key} & 63 AS INT))) AS bits, count(*) AS n{adds}
                        FROM (SELECT {natural}, {key}{flags} FROM {{t}}) GROUP BY {natural}, shiftright({key}, 6)))
            GROUP BY word"""
        checks = [("unique:" + natural.replace(" ", ""), "sum(twice)")]
    else:
        ints = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("int", "bigint")}
        cells = ", ".join(
            f"named_struct('which', {i}, 'word', shiftright(CAST({c} AS BIGINT), 6), 'bit', shiftleft(1L, CAST({c} & 63 AS INT)), 'text', CAST(NULL AS STRING))"
            if c in ints else f"named_struct('which', {i}, 'word', CAST(NULL AS BIGINT), 'bit', CAST(NULL AS BIGINT), 'text', {c})"
            for i, c in enumerate(keys))
        parts = f"""
            SELECT k.which, k.word, k.text, bit_or(k.bit) AS bits, count(*) AS n{adds}
            FROM (SELECT explode(array({cells})) AS k{flags} FROM {{t}}) GROUP BY k.which, k.word, k.text"""
        checks = []
    # a group without bits is one key: a text, or NULL
    checks += [(f"unique:{c}", f"sum(CASE WHEN which = {i} THEN n - coalesce(bit_count(bits), 1) END)") for i, c in enumerate(keys)]
    checks += [(name, f"sum(CASE WHEN which = 0 THEN _c{i} END)") for i, (name, _) in enumerate(tests)]
    values = ", ".join(f"CAST(coalesce({v}, 0) AS BIGINT) AS _v{i}" for i, (_, v) in enumerate(checks))
    rows = ", ".join(f"named_struct('check_name', '{name}', 'violations', _v{i})" for i, (name, _) in enumerate(checks))
    return wh.spark.sql(f"""
        SELECT r.check_name, '{table}' AS table_name, r.violations
        FROM (SELECT explode(array({rows})) AS r FROM (SELECT {values} FROM ({parts})))""", t=df)


# Rows of a dimension whose bitmap one task makes, without a shuffle.
SMALL_PARENT = 200_000


def _parent_words(wh: Warehouse, dim: str, key: str) -> DataFrame:
    small = wh.rows.get(dim, SMALL_PARENT + 1) <= SMALL_PARENT
    return words(wh[dim].select(key).coalesce(1) if small else wh[dim], key)


def _ships(wh: Warehouse, dim: str, key: str) -> bool:
    return ships(wh.rows.get(dim), lambda: words(wh[dim], key))


def _large_key_misses(wh: Warehouse, table: str, column: str, dim: str, key: str) -> DataFrame:
    """A foreign key into a parent whose bitmap is too large to ship: both sides' words are joined,
    child bits AND NOT parent bits, and the child rows of the bits that remain are counted."""
    missing = (words(wh[table], column).join(words(wh[dim], key).withColumnRenamed("bits", "_held"), "word", "left")
               .select("word", F.expr("bits & ~coalesce(_held, 0L)").alias("bits")).filter("bits <> 0"))
    rows = wh[table].select(F.col(column).alias("_k")).join(missing, word_of(F.col("_k")) == F.col("word"))
    return (rows.filter(F.col("bits").bitwiseAND(bit_of(F.col("_k"))) != 0)
            .agg(F.count(F.lit(1)).cast("long").alias("violations"))
            .select(F.lit(f"fk:{column}->{dim}").alias("check_name"), F.lit(table).alias("table_name"), "violations"))


def audit_constraints(wh: Warehouse) -> DataFrame:
    """Q6: violation counts for the schema's PK/UNIQUE, NOT NULL, CHECK and FK constraints,
    one scan per table."""
    tables = dict.fromkeys([t for t, _ in _UNIQUE] + [t for t, _, _, _ in _FK]
                           + [t for t, _ in _NOT_NULL] + [t for t, _ in _CHECK])
    parts = [_table_checks(wh, t) for t in tables]
    parts += [_large_key_misses(wh, *fk) for fk in _FK if not _ships(wh, fk[2], fk[3])]
    return reduce(DataFrame.union, parts)


# What a build step may leave out (W5-W7, W12, D10), listed even where nothing was.
REJECTS = [*[("order_items", r) for r in ITEM_REASONS], ("customers", "duplicate"), ("products", "duplicate"),
           ("sellers", "duplicate"), ("translation", "duplicate"), ("closed_deals", "no_seller"),
           ("closed_deals", "later_deal_of_seller"), ("closed_deals", "no_lead"), ("closed_deals", "later_deal_of_lead")]


def rejects(wh: Warehouse) -> DataFrame:
    """Rows that the build left out, by table and reason, from its stored reject stream."""
    none = wh.spark.createDataFrame([(t, r, 0) for t, r in REJECTS], "table_name string, reason string, rows long")
    return (wh.rejected.select("table_name", "reason", "rows").unionByName(none)
            .groupBy("reason", "table_name").agg(F.sum("rows").cast("long").alias("violations")))


def stage_counts(wh: Warehouse) -> DataFrame:
    """Rows in per raw input and rows out per warehouse table, from the build's ledger."""
    return (wh.ledger.filter("role in ('in', 'out')")
            .groupBy(F.when(F.col("role") == "in", "raw").otherwise("warehouse").alias("stage"), "table_name")
            .agg(F.sum("rows").cast("long").alias("row_count")))


def audit_status(wh: Warehouse) -> DataFrame:
    """Q7: PASS/FAIL per reconciliation target (target 0 each).  Balances come from the ledger, what was
    left out from the reject stream; the raw leads and deals are read once, for the dates."""
    out = wh.rejected
    rows = lambda reason: F.sum(F.when(F.col("reason") == reason, F.col("rows")))
    keys = lambda reason: F.count(F.when(F.col("reason") == reason, 1))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    # the first deal of an unknown lead or seller is no duplicate
    left_out = out.agg(
        zero(zero(rows("later_deal_of_lead")) + zero(rows("no_lead")) - keys("no_lead")).alias("closed_mql_duplicates"),
        zero(zero(rows("later_deal_of_seller")) + zero(rows("no_seller")) - keys("no_seller")).alias("seller_id_duplicates"),
        keys("no_lead").alias("orphan_closed_mqls"),
        zero(F.sum(F.when(F.col("reason").isin(*ITEM_REASONS) & (F.col("table_name") == "order_items"), F.col("rows")))).alias("rejected_items"))
    side = lambda role, table: F.sum(F.when((F.col("role") == role) & (F.col("table_name") == table), F.col("rows")).otherwise(0))
    balance = wh.ledger.agg((side("out", "fact_lead") - side("in", "mql")).alias("fact_lead_minus_leads"),
                            (side("out", "fact_order_item") - side("in", "order_items")).alias("items_loaded_minus_input"))

    def long_form(wide: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in wide.columns])
        return wide.select(F.explode(pairs).alias("m")).select("m.*")

    metrics = reduce(DataFrame.unionByName, [
        long_form(left_out), long_form(balance), audit_date_sanity(wh),
        duplicate_count(wh["fact_lead"], ["mql_id"]).select(F.lit("mql_duplicates").alias("metric"), F.col("duplicates").alias("value"))])
    # Check label per metric; every target is 0 except the
    # item balance, whose target is minus the rejected count (checked below).
    labels = {"mql_duplicates": "mql_id unique", "closed_mql_duplicates": "deal mql_id unique",
              "seller_id_duplicates": "deal seller_id unique",
              "date_sanity_violations": "won on/after first contact",
              "orphan_closed_mqls": "every deal has a lead", "fact_lead_minus_leads": "fact_lead rows = leads",
              "items_loaded_minus_input": "items loaded = items in - rejected",
              "rejected_items": "rejected items (reported)"}
    label = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    rej_total = F.sum(F.when(F.col("metric") == "rejected_items", F.col("value"))).over(Window.partitionBy())
    target = (F.when(F.col("metric") == "items_loaded_minus_input", -rej_total)
              .when(F.col("metric") == "rejected_items", F.col("value")).otherwise(F.lit(0)).cast("long"))
    return (metrics.select(F.element_at(label, F.col("metric")).alias("check_name"), "metric", "value",
                           target.alias("target"))
            .withColumn("status", F.when(F.col("value") == F.col("target"), "PASS").otherwise("FAIL")))
