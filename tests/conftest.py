import os
import sys
import tempfile
from datetime import datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from leadlens.session import get_session
    ckpt = tempfile.mkdtemp(prefix="leadlens-test-", dir="/tmp")
    s = get_session("local[4]", app_name="leadlens-tests", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


def _ts(s):
    return datetime.fromisoformat(s) if s else None


@pytest.fixture(scope="session")
def tiny_raw(spark):
    """Hand-made raw inputs (FIXTURES §4) covering the edge cases."""
    from leadlens.sources.raw import RAW_SCHEMAS

    def df(name, rows):
        schema = RAW_SCHEMAS[name]
        fields = [f for f in schema.fields if f.name != "_corrupt_record"]
        from pyspark.sql.types import StructType
        return spark.createDataFrame(rows, StructType(fields))

    mql = df("mql", [
        ("m1", _ts("2018-01-01 10:00:00"), "lp1", "paid_search"),
        ("m2", _ts("2018-01-02 10:00:00"), "lp1", "  Paid_Search "),   # padded, mixed case
        ("m3", _ts("2018-01-03 10:00:00"), None, None),               # NULL origin and page
        ("m4", _ts("2018-01-04 10:00:00"), "lp2", "social"),
        ("m5", _ts("2018-01-05 10:00:00"), "lp2", "social"),
        ("m6", _ts("2018-03-01 10:00:00"), "lp2", "social"),
    ])
    deal = lambda mql_id, seller, won, seg: (mql_id, seller, "sdr1", "sr1", _ts(won), seg, "reseller", "cat",
                                             1, 0, "1-5", "reseller", 10.0, Decimal("1000.00"))
    closed = df("closed_deals", [
        deal("m1", "s1", "2018-01-11 12:00:00", "pet"),
        deal("m2", "s2", "2018-01-05 12:00:00", None),
        deal("m6", "s6", "2018-02-01 12:00:00", "pet"),                # won before first contact
        deal("m9", "s9", "2018-01-20 12:00:00", "pet"),                # orphan deal (no lead)
        deal("m4", "s2", "2018-02-20 12:00:00", "baby"),               # second deal for seller s2
    ])
    orders = df("orders", [
        ("o1", "c1", "delivered", _ts("2018-01-11 10:00:00"), None, None, None, None),   # 2 h before won -> -1
        ("o2", "c1", "delivered", _ts("2018-01-11 12:00:00"), None, None, None, None),   # exactly won -> 0
        ("o3", "c2", "canceled", _ts("2018-02-15 08:00:00"), None, None, None, None),
        ("o4", "c2", "delivered", _ts("2018-03-15 08:00:00"), None, None, None, None),
    ])
    items = df("order_items", [
        ("o1", 1, "p1", "s1", None, Decimal("10.00"), Decimal("1.00")),
        ("o2", 1, "p1", "s1", None, Decimal("20.00"), Decimal("2.00")),
        ("o3", 1, "p2", "s2", None, Decimal("30.00"), Decimal("3.00")),
        ("o4", 1, "p3", "s2", None, Decimal("40.00"), Decimal("4.00")),
        ("o4", 2, "pX", "s2", None, Decimal("50.00"), Decimal("5.00")),   # unmapped product -> rejected
    ])
    reviews = df("order_reviews", [
        ("r1", "o1", 2, None, None, None, None), ("r2", "o1", 3, None, None, None, None),   # mean 2.5 -> 2
        ("r3", "o2", 3, None, None, None, None), ("r4", "o2", 4, None, None, None, None),   # mean 3.5 -> 4
    ])
    customers = df("customers", [("c1", "u1", 1000, "city", "SP"), ("c2", "u2", 1000, "city", "RJ")])
    sellers = df("sellers", [("s1", 1, "a", "SP"), ("s2", 1, "b", "RJ"), ("s6", 1, "c", "MG"),
                             ("s7", 1, "d", "MG")])
    products = df("products", [("p1", "cama", 1, 1, 1, 500.0, 1, 1, 1), ("p2", None, 1, 1, 1, None, 1, 1, 1),
                               ("p3", "beleza", 1, 1, 1, 20.0, 1, 1, 1)])
    trans = df("translation", [("cama", "bed")])
    return {"mql": mql, "closed_deals": closed, "orders": orders, "order_items": items,
            "order_reviews": reviews, "customers": customers, "sellers": sellers, "products": products,
            "translation": trans}


@pytest.fixture(scope="session")
def tiny_wh(spark, tiny_raw):
    from leadlens.plans.warehouse import build_warehouse
    return build_warehouse(spark, tiny_raw, ("2017-12-01", "2018-12-31"))
