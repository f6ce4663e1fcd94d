import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.config import CENTER, DATE, QTY
from tidecast.functions.calendar import utc_date
from tidecast.operators.daily import attach_centers, attach_products, daily_demand
from tidecast.sources import loader, sinks

ITEMS = """,id,order_id,user_id,product_id,inventory_item_id,status,created_at,shipped_at,delivered_at,returned_at,sale_price
0,901,11,21,301,401,Complete,2024-03-02 06:30:00 UTC,,,,12.5
1,902,12,22,301,402,Shipped,2024-03-03 18:05:07 UTC,2024-03-01 09:00:00 UTC,,,12.5
2,903,13,23,399,403,Returned,2024-04-30 23:59:58.250000 UTC,,,,8.0
"""
CENTERS = """,id,name,latitude,longitude
0,1,Alder Hub,10.5,-20.25
1,2,Birch Hub,11.5,-21.25
"""
PRODUCTS = """,id,cost,category,name,brand,retail_price,department,sku,distribution_center_id
0,301,4.0,Footwear,"6"" boot, brown",Acme,9.75,Outdoor,S-301,1
1,302,5.0,Footwear,"Sandal,
two straps",Acme,8.25,Outdoor,S-302,2
2,303,5.5,Footwear,"Back\\slash ""shoe""\\",Acme,7.25,Outdoor,S-303,2
"""


@pytest.fixture
def paths(tmp_path):
    out = []
    for name, text in (("items", ITEMS), ("centers", CENTERS), ("products", PRODUCTS)):
        (tmp_path / f"{name}.csv").write_text(text)
        out.append(str(tmp_path / f"{name}.csv"))
    return out


def test_loads_three_tables(spark, paths):
    items, centers, products = loader.load_data(spark, *paths)
    assert items.columns[0] == "id" and "_c0" not in items.columns
    assert dict(items.dtypes)["created_at"] == "timestamp" and dict(items.dtypes)["sale_price"] == "double"
    assert centers.columns == [CENTER, "distribution_center_name", "distribution_center_latitude",
                               "distribution_center_longitude"]
    assert all(c.startswith("product_") for c in products.columns)
    assert (items.count(), centers.count(), products.count()) == (3, 2, 3)
    assert items.where("shipped_at is null").count() == 2


def test_quotes_commas_and_line_breaks_are_read_as_pandas_reads_them(spark, paths):
    want = pd.read_csv(paths[2], index_col=0)
    got = loader.load_data(spark, *paths)[2].toPandas()
    for c in want.columns:
        assert got[f"product_{c}"].tolist() == want[c].tolist()


def test_malformed_rows_are_shown(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("id,status,created_at\n1,ok,2024-01-01\nx,ok,2024-01-01\n3,ok,never\n4\n")
    bad = [r.record for r in loader.malformed_rows(spark, str(path), {"id": "bigint", "created_at": "timestamp"}).collect()]
    assert sorted(bad) == ["4", "never", "x,ok,2024-01-01"]
    assert loader.read_csv(spark, str(path), {"id": "bigint"}).count() == 4


def test_unknown_product_is_dropped_from_demand(spark, paths):
    items, centers, products = loader.load_data(spark, *paths)
    merged = attach_products(items, attach_centers(products, centers))
    assert merged.count() == 3 and merged.where(F.col(CENTER).isNull()).count() == 1
    assert {(r[CENTER], r[DATE], r[QTY]) for r in daily_demand(merged).collect()} == {
        (1, dt.date(2024, 3, 2), 1), (1, dt.date(2024, 3, 3), 1)}


def test_sources_without_common_products_give_no_demand(spark, paths):
    items, centers, products = loader.load_data(spark, *paths)
    merged = attach_products(items.where("product_id = 399"), attach_centers(products, centers))
    assert daily_demand(merged).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_date_is_utc_in_any_zone(spark, paths, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        text = spark.createDataFrame([("2024-01-13 23:59:53 UTC",), ("2024-02-26 00:00:01.145355 UTC",),
                                      ("2024-02-26 23:30:00",), ("2024-02-26",), ("junk",), (None,)], "t string")
        assert [r.d for r in text.select(utc_date(text, "t").alias("d")).collect()] == [
            dt.date(2024, 1, 13), *[dt.date(2024, 2, 26)] * 3, None, None]
        items = loader.load_data(spark, *paths)[0]
        days = items.select(utc_date(items, "created_at").cast("string").alias("d"))
        assert {r.d for r in days.collect()} == {"2024-03-02", "2024-03-03", "2024-04-30"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_failures(spark, paths, tmp_path):
    with pytest.raises(ValueError):
        loader.load_data(spark, paths[0], None, paths[2])
    with pytest.raises(FileNotFoundError):
        loader.load_data(spark, str(tmp_path / "absent.csv"), paths[1], paths[2])
    (tmp_path / "bad.csv").write_text("name,latitude,longitude\nMemphis TN,1,2\n")
    with pytest.raises(ValueError):
        loader.load_data(spark, paths[0], str(tmp_path / "bad.csv"), paths[2])


def test_inferred_and_series_reads(spark, tmp_path):
    path = tmp_path / "days.csv"
    path.write_text("qty,date,year\n4,2024-01-01,2024\n5,2024-01-02,2024\n")
    assert dict(loader.infer_csv(spark, str(path)).dtypes)["qty"] == "int"
    df = loader.read_series(spark, str(path), types={"qty": "bigint"})
    assert df.dtypes == [("date", "date"), ("qty", "bigint"), ("year", "string")]


def test_sinks(spark, tmp_path, paths):
    items, centers, _ = loader.load_data(spark, *paths)
    sinks.save_sample(items, str(tmp_path / "sample"), ["id"], n=2, fmt="csv")
    again = loader.read_csv(spark, str(tmp_path / "sample"), {"id": "bigint"})
    assert [r.id for r in again.orderBy("id").collect()] == [901, 902]
    assert sinks.preview_view(centers, "centers_view", CENTER, 1).collect()[0][CENTER] == 1

    rows = spark.createDataFrame([("train", 1), ("test", 2)], "split string, qty int")
    sinks.save_splits(rows, str(tmp_path / "splits"))
    test = sinks.load_split(spark, str(tmp_path / "splits"), "test")
    assert test.collect()[0].qty == 2
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()

    for i in range(2):
        sinks.record_run(spark, str(tmp_path / "runs"), f"run{i}", "linear", {"lags": 14}, {"rmse": 1.5}, {"scaling": None})
    runs = sinks.load_runs(spark, str(tmp_path / "runs")).orderBy("run_name").collect()
    assert len(runs) == 2 and runs[0].metrics == {"rmse": 1.5} and runs[1].params == {"lags": "14"}
