"""Local stand-in for the driver's check: Spark result vs DuckDB twin.

Compares row count, column names and an order-insensitive hash of values
(floats rounded to 12 significant digits so both engines' text forms agree; integers and
decimals exactly).
"""

from __future__ import annotations

import decimal
import hashlib
import math
from collections.abc import Callable

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return _plain(f"{v:.12g}")
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, decimal.Decimal)):
        return _plain(str(v))
    return str(v)


def _plain(text: str) -> str:
    """One text for a number of whichever type: 2, 2.0 and 2E+0 are equal."""
    return format(decimal.Decimal(text).normalize(), "f")


def table_hash(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


def compare(spark, sf_dir: str, queries: dict[str, Callable], oracle: dict[str, str],
            names: list[str] | None = None, con=None, verbose: bool = True) -> dict[str, dict]:
    con = con or duck_connect(sf_dir)
    out = {}
    for name in names or list(queries):
        rec: dict = {}
        try:
            sdf = queries[name](spark, sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
            rec["spark_rows"] = len(s_rows)
            if name in oracle:
                res = con.execute(oracle[name])
                d_cols = [c[0] for c in res.description]
                d_rows = res.fetchall()
                rec["oracle_rows"] = len(d_rows)
                rec["columns_match"] = sorted(c.lower() for c in s_cols) == sorted(c.lower() for c in d_cols)
                rec["hash_match"] = table_hash(s_cols, s_rows) == table_hash(d_cols, d_rows)
                rec["ok"] = rec["columns_match"] and rec["hash_match"] and len(s_rows) == len(d_rows)
                if not rec["ok"]:
                    rec["spark_cols"], rec["oracle_cols"] = s_cols, d_cols
                    rec["spark_sample"] = sorted(map(str, s_rows))[:3]
                    rec["oracle_sample"] = sorted(map(str, d_rows))[:3]
            else:
                rec["ok"] = None
        except Exception as e:  # noqa: BLE001
            rec["ok"] = False
            rec["error"] = f"{type(e).__name__}: {str(e)[:600]}"
        out[name] = rec
        if verbose:
            print(name, rec, flush=True)
    return out
