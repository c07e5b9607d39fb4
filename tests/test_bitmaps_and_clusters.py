"""Bitmap counts, key checks, clustered facts, the ledger and the reject stream."""

import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leadlens.operators import bitmaps
from leadlens.plans import audit, measures, primitives, revenue
from leadlens.plans.warehouse import build_warehouse, clustered_orders, joined_lines


def plan(df):
    """The physical plan before adaptive changes."""
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts_match_plain_ones(spark):
    rows = [(g, k, k % 7 - 3 if k % 5 else None, 1.5) for g in ("a", "b", None) for k in list(range(0, 300, 3)) * 2 + [2 ** 40, -1, -64, -65, 2 ** 62]]
    df = spark.createDataFrame(rows, "g string, k long, j long, x double")
    got = bitmaps.distinct_counts(df, ["g"], {"ks": F.col("k"), "js": F.col("j")}, {"s": F.col("x")})
    want = df.groupBy("g").agg(F.countDistinct("k").alias("ks"), F.countDistinct("j").alias("js"), F.sum("x").alias("s"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    one = bitmaps.distinct_counts(df, [], {"js": F.col("j"), "ks": F.col("k")}).collect()
    assert [(r.js, r.ks) for r in one] == [(7, 105)]
    assert bitmaps.distinct_counts(df.filter("false"), ["g"], {"ks": F.col("k")}).collect() == []


def test_sets_merge_to_any_grain(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), (F.col("id") % 4).alias("b"), (F.col("id") * 7 % 331).alias("k"))
    fine = bitmaps.words(df, "k", ["a", "b"])
    for by in (["a"], ["b"], []):
        got = bitmaps.sizes(bitmaps.merged(fine, by), by).collect()
        want = df.groupBy(*by).agg(F.countDistinct("k").alias("n")).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_membership_never_repeats_a_row(spark):
    child = spark.createDataFrame([(1,), (1,), (64,), (None,), (-5,), (7,)], "k long")
    parent = spark.createDataFrame([(1,), (1,), (64,), (2 ** 50,)], "p long")
    got = bitmaps.membership(child, [("k", bitmaps.words(parent, "p"), "hit")]).collect()
    assert sorted((repr(r.k), r.hit) for r in got) == sorted([("1", True), ("1", True), ("64", True), ("None", None), ("-5", False), ("7", False)])


def test_no_expand_above_the_facts(tiny_wh):
    for df in (primitives.count_distinct(tiny_wh), revenue.channel_matrix(tiny_wh), audit.audit_constraints(tiny_wh),
               *[measures.measures(tiny_wh, g) for g in ("origin", "overall", "month")]):
        assert not any("Expand" in p for p in plan(df))


def test_facts_meet_and_group_without_a_shuffle(spark, tiny_raw, tiny_wh):
    lines, heads = clustered_orders(tiny_wh, tiny_raw, 3)
    joined = plan(joined_lines(lines, heads).groupBy("order_id").count())[1]
    assert "Join" in joined and not re.search(r"\bExchange\b", joined)
    sums = plan(revenue.seller_order_totals(revenue.post_signing_items(tiny_wh, exclude_canceled=True)))[1]
    assert not re.search(r"\bExchange\b", sums)


def test_constraints_read_each_fact_once(tiny_wh):
    text = plan(audit.audit_constraints(tiny_wh))[1]
    assert len(re.findall(r"FileScan[^\n]*freight_value", text)) == 1       # the item fact
    assert len(re.findall(r"FileScan[^\n]*is_won", text)) == 1             # the lead fact


def broken(spark, tiny_raw):
    """Inputs with every kind of row that a build leaves out."""
    raw = dict(tiny_raw)
    twice = lambda name, n=1: raw[name].unionByName(raw[name].limit(n))
    raw["customers"], raw["products"], raw["translation"] = twice("customers"), twice("products", 2), twice("translation")
    raw["sellers"] = raw["sellers"].unionByName(raw["sellers"].filter("seller_id = 's7'")).unionByName(raw["sellers"].filter("seller_id = 's7'"))
    item = lambda order, product, seller: (order, 9, product, seller, None, Decimal("1.00"), Decimal("1.00"))
    raw["order_items"] = raw["order_items"].unionByName(spark.createDataFrame(
        [item("o99", "p1", "s1"), item(None, "p1", "s1"), item(None, "p1", "s1"), item("o1", "p1", "nobody"), item("o5", "p1", "s1")],
        raw["order_items"].schema))
    raw["orders"] = raw["orders"].unionByName(spark.createDataFrame(
        [("o5", "c99", "delivered", datetime(2018, 3, 1), None, None, None, None), (None, "c1", "delivered", datetime(2018, 3, 1), None, None, None, None)],
        raw["orders"].schema))
    return raw


def test_rejects_and_ledger(spark, tiny_raw):
    raw = broken(spark, tiny_raw)
    corrupt = spark.createDataFrame([("mql", "m77", "m77,soon"), ("mql", "m77", "m77,later")], "table string, key string, record string")
    wh = build_warehouse(spark, raw, ("2017-12-01", "2018-12-31"), corrupt=corrupt)
    got = {(r.table_name, r.reason): r.violations for r in audit.rejects(wh).collect()}
    assert got == {("order_items", "no_order"): 3, ("order_items", "unmapped_seller"): 1, ("order_items", "unmapped_product"): 1,
                   ("order_items", "unmapped_customer"): 1, ("customers", "duplicate"): 1, ("products", "duplicate"): 2,
                   ("sellers", "duplicate"): 2, ("translation", "duplicate"): 1, ("closed_deals", "no_seller"): 1,
                   ("closed_deals", "later_deal_of_seller"): 1, ("closed_deals", "no_lead"): 1, ("closed_deals", "later_deal_of_lead"): 0,
                   ("mql", "corrupt"): 2}
    keys = {(r.table_name, r.reason, r.key) for r in wh.rejected.collect()}
    assert {("order_items", "no_order", "o99"), ("sellers", "duplicate", "s7"), ("closed_deals", "no_lead", "m9"),
            ("closed_deals", "no_seller", "s9"), ("mql", "corrupt", "m77")} <= keys
    counts = {(r.stage, r.table_name): r.row_count for r in audit.stage_counts(wh).collect()}
    for name, df in raw.items():
        assert counts["raw", name] == df.count(), name
    for name in wh.tables:
        assert counts["warehouse", name] == wh[name].count(), name
    status = {r.metric: (r.value, r.status) for r in audit.audit_status(wh).collect()}
    assert status["orphan_closed_mqls"] == (1, "FAIL") and status["rejected_items"][0] == 6
    assert status["items_loaded_minus_input"] == (-6, "PASS") and status["fact_lead_minus_leads"] == (0, "PASS")
    dups = {r.metric: r.value for r in audit.audit_dups(wh).collect()}
    assert {m: status[m][0] for m in dups} == dups


def test_large_parents_are_checked_by_words(spark, tiny_raw, monkeypatch):
    wh = build_warehouse(spark, tiny_raw, ("2017-12-01", "2018-12-31"))
    kept = wh["dim_seller"].filter("seller_key <> 1")
    wh.tables["dim_seller"] = kept
    want = {(r.check_name, r.table_name): r.violations for r in audit.audit_constraints(wh).collect()}
    assert want["fk:seller_key->dim_seller", "fact_order_item"] == 2
    monkeypatch.setattr(audit, "_ships", lambda *a: False)
    assert {(r.check_name, r.table_name): r.violations for r in audit.audit_constraints(wh).collect()} == want


def test_duplicated_keys_are_counted(spark, tiny_raw):
    wh = build_warehouse(spark, tiny_raw, ("2017-12-01", "2018-12-31"))
    wh.tables["fact_lead"] = wh["fact_lead"].unionByName(wh["fact_lead"].limit(2))
    wh.tables["fact_order_item"] = wh["fact_order_item"].unionByName(wh["fact_order_item"].filter("order_id = 'o1'"))
    got = {(r.check_name, r.table_name): r.violations for r in audit.audit_constraints(wh).collect()}
    assert got["unique:lead_key", "fact_lead"] == 2 and got["unique:mql_id", "fact_lead"] == 2
    assert got["unique:order_item_key", "fact_order_item"] == 1 and got["unique:order_id,order_item_id", "fact_order_item"] == 1


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running_offsets(spark, n):
    from leadlens.operators.keys import running_offsets
    df = spark.createDataFrame([(f"k{i:04d}", 1 + i * i % 5) for i in range(n)], "k string, n long").repartition(7)
    got, total = running_offsets(df, "k", "n", "before")
    rows = sorted((r.k, r.before) for r in got.collect())
    want, run = [], 0
    for i in range(n):
        want.append((f"k{i:04d}", run))
        run += 1 + i * i % 5
    assert rows == want and total == run
