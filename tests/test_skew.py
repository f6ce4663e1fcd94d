"""A third of all items belong to one order, one product, one supplier and one price."""

import pytest
from conftest import SMALL
from oracle_check import TABLES, compare, connect
from pyspark.sql import functions as F

from tidecast.operators import profile
from tidecast.plans.catalog import QUERIES
from tidecast.plans.oracle import ORACLE

CHECKED = ("daily_demand", "product_daily_demand", "features_qty_lags", "pareto_products", "describe_prices",
           "distinct_counts", "duplicate_rows", "lr_one_lag", "product_demand_from_mix", "order_quantity_per_product")


def write_skewed(spark, source: str, folder: str, columns=("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")):
    for name in TABLES:
        df = spark.read.parquet(f"{source}/{name}.parquet")
        if name == "lineitem":
            hot = F.pmod(F.hash("l_orderkey", "l_partkey", "l_linenumber"), F.lit(3)) == 0
            order = spark.read.parquet(f"{source}/orders.parquet").agg(F.max_by("o_orderkey", "o_orderdate")).first()[0]
            fixed = {"l_orderkey": order, "l_partkey": 7, "l_suppkey": 3, "l_extendedprice": 99.5}
            df = df.withColumns({
                c: F.when(hot, F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in fixed.items() if c in columns})
        # Several files make several map tasks, along which a hot partition can be cut.
        df.repartition(8 if name == "lineitem" else 1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    return write_skewed(spark, SMALL, str(tmp_path_factory.mktemp("skewed")))


@pytest.fixture(scope="module")
def con(skewed):
    return connect(skewed)


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("name", CHECKED)
def test_skewed_results_match_sql(spark, skewed, con, name, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not broadcast:
        # Every join shuffles, and partitions of a few kilobytes already count as skewed.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4KB")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4KB")
    try:
        assert compare(QUERIES[name](spark, skewed).toPandas(), con.execute(ORACLE[name]).df()) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_hot_order_is_split_by_the_join(spark, tmp_path):
    """The fact join shuffles by order; the partition of the hot order is cut into several tasks."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB"}
    skewed = write_skewed(spark, "/root/testdata/sf0.1", str(tmp_path), ("l_orderkey",))
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = QUERIES["daily_demand_one_dc"](spark, skewed)
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_duplicates_of_a_hot_order_are_counted_behind_an_exchange(spark):
    """Grouped where the join left them, all items of the hot order would be in one task, which AQE cannot split then."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB"}
    # 60,000 items of one order and 20,000 of 2,000 others; every seventh item comes twice, with nulls and zeros of both signs.
    items = spark.range(0, 80_000, 1, 8).select(
        F.when(F.col("id") < 60_000, 1).otherwise(2 + F.col("id") % 2_000).alias("order_id"), "id",
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("price"))
    again = items.where("id % 7 = 0")
    rows = items.withColumn("x", F.lit(0.0)).union(again.withColumn("x", F.lit(-0.0)))
    orders = spark.range(1, 2_002, 1, 2).select(F.col("id").alias("order"), (F.col("id") % 3).cast("string").alias("status"))
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = profile.duplicate_rows(rows.join(orders, F.col("order_id") == F.col("order"), "left"))
        assert df.collect()[0][0] == 11_429
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
