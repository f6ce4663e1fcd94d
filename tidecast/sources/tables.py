"""Order items out of a star schema of parquet tables.

One line item is one unit of demand. Its day and status come from the order, its distribution
center is the nation of its supplier, so the center is a property of the item and not of the
product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.config import CENTER, CENTER_NAME


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, or of a database where ``folder`` is the name of one (bucketed tables keep their buckets)."""
    if "/" not in folder and spark.catalog.databaseExists(folder):
        return spark.table(f"{folder}.{name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def centers(spark: SparkSession, folder: str) -> DataFrame:
    """The distribution-center dimension, with its region."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.col("n_nationkey").cast("bigint").alias(CENTER),
        F.col("n_name").alias(CENTER_NAME),
        F.col("r_regionkey").alias("region_id"),
        F.col("r_name").alias("region_name"),
    )


# Columns of an item and the table each comes from.
ITEM_COLUMNS = {
    "order_id": "lineitem", "product_id": "lineitem", "status": "orders", "created_at": "orders",
    "sale_price": "lineitem", CENTER: "supplier",
}


def order_items(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Items with the asked columns, or with all: order, product, status, day, price, center.

    Only tables that provide an asked column are joined: a left join drops no item, but Spark
    cannot know that it adds none and would not leave it out. The joins carry no hints:
    Catalyst broadcasts a side whose statistics fall under the threshold, otherwise sorts and
    merges, and AQE splits a hot order or supplier.
    """
    columns = columns or tuple(ITEM_COLUMNS)
    needed = {ITEM_COLUMNS[c] for c in columns}
    items = table(spark, folder, "lineitem")
    if "orders" in needed:
        items = items.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "supplier" in needed:
        items = items.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    source = {
        "order_id": "l_orderkey", "product_id": "l_partkey", "status": "o_orderstatus",
        "created_at": "o_orderdate", "sale_price": "l_extendedprice", CENTER: "s_nationkey",
    }
    return items.select(*[
        (F.col(source[c]).cast("bigint") if c == CENTER else F.col(source[c])).alias(c) for c in columns])


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("retail_price"),
    )
