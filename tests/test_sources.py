"""Raw CSV source (S1) through landing (S2) into the warehouse, and the CSV/JSON sinks."""

import json
import os
import tempfile


def _write_raw_csvs(tiny_raw, folder):
    """The hand-made inputs as header CSV files named like the reference's raw folder."""
    from leadlens.sources.raw import RAW_FILES
    for name, df in tiny_raw.items():
        pdf = df.toPandas()               # a handful of fixture rows
        pdf.to_csv(os.path.join(folder, RAW_FILES[name]), index=False, date_format="%Y-%m-%d %H:%M:%S")


def test_csv_inputs_build_the_same_warehouse(spark, tiny_raw, tiny_wh):
    from leadlens.plans.revenue import channel_matrix
    from leadlens.plans.warehouse import build_warehouse
    from leadlens.sources.raw import read_raw
    folder = tempfile.mkdtemp(prefix="leadlens-raw-", dir="/tmp")
    _write_raw_csvs(tiny_raw, folder)
    raw = read_raw(spark, folder, list(tiny_raw))
    wh = build_warehouse(spark, raw, ("2017-12-01", "2018-12-31"), land=True)
    for t in ("fact_lead", "dim_seller", "dim_origin"):
        cols = [c for c in tiny_wh[t].columns]
        assert sorted(map(tuple, wh[t].select(*cols).collect())) == sorted(map(tuple, tiny_wh[t].select(*cols).collect()))
    a = sorted(map(tuple, channel_matrix(wh).collect()))
    b = sorted(map(tuple, channel_matrix(tiny_wh).collect()))
    assert a == b


def test_unparsable_csv_row_keeps_nulls(spark):
    from leadlens.sources.raw import RAW_SCHEMAS, read_csv
    folder = tempfile.mkdtemp(prefix="leadlens-bad-", dir="/tmp")
    path = os.path.join(folder, "mql.csv")
    with open(path, "w") as f:
        f.write("mql_id,first_contact_date,landing_page_id,origin\n"
                "m1,2018-01-01,lp1,social\n"
                "m2,not a date,lp1,social\n")
    rows = {r.mql_id: r for r in read_csv(spark, path, RAW_SCHEMAS["mql"]).collect()}
    assert rows["m1"].first_contact_date is not None and rows["m1"]._corrupt_record is None
    assert rows["m2"].first_contact_date is None and rows["m2"]._corrupt_record is not None


def test_csv_and_json_sinks(spark):
    from leadlens.sources.sinks import write_csv, write_json
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", float("inf"))], "k string, v double")
    folder = tempfile.mkdtemp(prefix="leadlens-sink-", dir="/tmp")
    write_csv(df, folder + "/csv")
    back = spark.read.option("header", True).csv(folder + "/csv")
    assert sorted(r.k for r in back.collect()) == ["a", "b", "c"]
    write_json(df, folder + "/json")
    recs = {}
    for p in os.listdir(folder + "/json"):
        if p.endswith(".json"):
            for line in open(os.path.join(folder, "json", p)):
                d = json.loads(line)
                recs[d["k"]] = d.get("v")
    assert recs == {"a": 1.0, "b": None, "c": None}


def test_views_and_csv_export(spark, tiny_wh):
    from leadlens.plans import catalog
    names = catalog.register_views(tiny_wh)
    assert "vw_powerbi_channel_matrix" in names and "fact_lead" in names
    via_sql = spark.sql("SELECT lead_origin, total_mqls FROM vw_powerbi_channel_matrix").collect()
    assert sorted(map(tuple, via_sql)) == sorted(
        map(tuple, tiny_wh["fact_lead"].join(tiny_wh["dim_origin"], "origin_key")
            .groupBy("origin_name").count().collect()))
    page = catalog.explorer(spark, tiny_wh, limit=2).collect()
    assert [r.lead_key for r in page] == [1, 2]
    folder = tempfile.mkdtemp(prefix="leadlens-export-", dir="/tmp")
    paths = catalog.export_csv(tiny_wh, folder)
    assert len(paths) == 11
    back = spark.read.option("header", True).csv(folder + "/dim_sdr")
    assert back.count() == tiny_wh["dim_sdr"].count()
