"""Shapes of physical plans that have to hold at any data size."""

from conftest import SMALL

from tidecast.operators import daily, features as feat
from tidecast.plans.catalog import CUT, KEYS, QUERIES, demand
from tidecast.sources import sinks, tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_pass_reads_few_columns_and_pushes_the_cutoff(spark):
    text = daily.daily_demand(tables.order_items(spark, SMALL), KEYS, CUT)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in text
    assert "LessThan(o_orderdate,2001-08-01T00:00)" in text
    assert text.count("partial_count(1)") == 1


def test_features_take_one_shuffle_after_the_fact_pass(spark):
    text = plan(feat.base_features(demand(spark, SMALL, CUT), CUT, targets=True))
    main = text.split("Subquer")[0]
    assert main.count("Exchange hashpartitioning") == 1


def test_fact_joins_survive_without_broadcast(spark):
    """The same rows come out when every join has to shuffle, as it will on big tables."""
    small = {tuple(r) for r in QUERIES["daily_demand"](spark, SMALL).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["daily_demand"](spark, SMALL)
        assert "BroadcastHashJoin" not in plan(df)
        assert {tuple(r) for r in df.collect()} == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_needed_tables_are_joined(spark):
    text = plan(QUERIES["items_per_product"](spark, SMALL))
    assert "orders" not in text and "supplier" not in text and "Join" not in text


def test_forecast_state_needs_no_window(spark):
    text = plan(feat.future_rows(demand(spark, SMALL, CUT), CUT))
    assert "Window" not in text and "Generate" not in text


def test_bucketed_facts_join_without_a_shuffle(spark, tmp_path):
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        sinks.save_bucketed(tables.table(spark, SMALL, name), f"bucketed_{name}", (key,), 4, str(tmp_path / name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items, orders = spark.table("bucketed_lineitem"), spark.table("bucketed_orders")
        text = plan(items.join(orders, items.l_orderkey == orders.o_orderkey, "left"))
        assert "SortMergeJoin" in text and "Exchange" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_lineitem")
        spark.sql("DROP TABLE bucketed_orders")


def test_split_ranges_are_broadcast_even_when_nothing_else_is(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["dense_demand_per_split"](spark, SMALL))
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
