"""What the warehouse build and the queries on top of it shuffle, sort and scan."""

import re
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

from leadlens.functions.exprs import date_key, day_floor
from leadlens.plans import measures, revenue
from leadlens.plans.warehouse import clustered_orders, joined_lines, order_counts


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_are_shuffled_once_for_their_order(spark, tmp_path):
    from leadlens.sources.testdata import raw_tables
    day = datetime(1997, 3, 1)
    rows = {
        "customer": ([(1, "a", 0, 1.0, "AUTO")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(10, 1, "F", 1.0, day, "1-URGENT"), (11, 1, "F", 1.0, day, "2-HIGH"), (None, 1, "F", 1.0, day, "2-HIGH")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(10, 5, 1, 1.0, 2.5, 0.1, day), (10, 5, 1, 1.0, 2.5, 0.1, day), (12, 5, 1, 1.0, 2.5, 0.1, day), (None, 5, 1, 1.0, 2.5, 0.1, day)],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_shipdate timestamp_ntz"),
        "part": ([(5, "SMALL", 3)], "p_partkey long, p_type string, p_size int"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = raw_tables(spark, str(tmp_path))["order_items"]
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        text = planned(items.repartition(n, "order_id"))
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 2        # lines and orders, and nothing after their join
        assert Counter(r.order_id for r in items.collect()) == {"o10": 2}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_day_floor_by_calendar_days(spark):
    base = datetime(2018, 2, 27, 23, 59, 59, 500000)
    pairs = [(base + timedelta(days=d, microseconds=u), base) for d in (-2, -1, 0, 1, 3) for u in (-1, 0, 1, 600000, 43200000000)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(-1, None, base), (-2, base, None)], "i int, a timestamp_ntz, b timestamp_ntz")
    got = {r.i: r.d for r in df.select("i", day_floor("a", "b").alias("d")).collect()}
    assert got == {i: (a - b) // timedelta(days=1) for i, (a, b) in enumerate(pairs)} | {-1: None, -2: None}
    assert "decimal(18,0)" not in planned(df.select(day_floor("a", "b")))     # a decimal per row and step before
    assert [r[0] for r in df.filter("i in (0, -1)").orderBy("i").select(date_key("a")).collect()] == [None, 20180225]
    assert "date_format" not in planned(df.select(date_key("a"))).split("ELSE")[0]


def test_items_left_out_are_counted_by_order(spark, tiny_raw, tiny_wh):
    item = lambda order, product, seller: (order, 9, product, seller, None, Decimal("1.00"), Decimal("1.00"))
    raw = dict(tiny_raw)
    raw["order_items"] = raw["order_items"].unionByName(spark.createDataFrame(
        [item("o99", "p1", "s1"), item("o1", "p1", "nobody"), item("o1", "nothing", "s1"), item("o1", "nothing", "nobody"), item(None, "p1", "s1")],
        raw["order_items"].schema))
    first = raw["orders"].filter("order_id = 'o1'")
    raw["orders"] = raw["orders"].unionByName(first).unionByName(
        first.selectExpr(*["'nobody' as customer_id" if c == "customer_id" else c for c in first.columns]))
    lines, heads = clustered_orders(tiny_wh, raw, 3)
    expected = Counter((r.order_id, r.reason or "_kept") for r in joined_lines(lines, heads, 3).collect())
    counts = order_counts(lines, heads, 3)
    got = {(r.order_id, n): r[n] for r in counts.collect() for n in counts.columns[1:] if r[n]}
    assert got == dict(expected) and {n for _, n in got} == {"_kept", "no_order", "unmapped_seller", "unmapped_product", "unmapped_customer"}
    assert not re.search(r"\bExchange\b", planned(counts))


def test_buckets_are_not_sorted_by_a_hash(tiny_wh, spark):
    name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("leadlens_"))
    rows = {r[0]: r[1] for r in spark.sql(f"describe extended {name}").collect()}
    assert rows["Bucket Columns"] == "[`order_id`]" and rows.get("Sort Columns") in (None, "[]")


def test_csv_is_parsed_once(spark, tmp_path):
    from leadlens.sources import raw as R
    path = tmp_path / "orders.csv"
    names = [f.name for f in R.RAW_SCHEMAS["orders"].fields if f.name != "_corrupt_record"]
    stamp = names.index("order_purchase_timestamp")
    line = lambda key, at: ",".join(key if i == 0 else at if i == stamp else "" for i in range(len(names)))
    path.write_text("\n".join([",".join(names), line("o1", "2018-01-01 00:00:00"), line("o2", "not a date"), line("o2", "2018-01-02 00:00:00")]) + "\n")
    df = R.read_csv(spark, str(path), R.RAW_SCHEMAS["orders"])
    got = R.outcomes(df)
    assert sorted((r.outcome, r.key) for r in got.collect()) == [("read", "o1"), ("read", "o2"), ("rejected", "o2")]
    assert planned(got).count("FileScan csv") == 1


def test_cohorts_count_rows_and_first_orders_are_hashed(tiny_wh):
    assert "distinct" not in planned(revenue.cohort_matrix(tiny_wh)).lower()

    class Plans:
        """The warehouse's tables, with derived ones planned and not written."""
        def __getitem__(self, name):
            return tiny_wh[name]

        def derived(self, name, build, aggregated):
            return build()

    assert "SortAggregate" not in planned(measures._seller_orders(Plans(), True, (90, 180)))
