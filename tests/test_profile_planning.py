import numpy as np
import pandas as pd
import pytest
from conftest import day
from pyspark.sql import functions as F

from tidecast.config import CENTER, ForecastConfig
from tidecast.operators import sketches
from tidecast.operators import planning, profile
from tidecast.operators.ranking import running_total

KEYS = (CENTER,)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_running_total_with_a_hot_value(spark, partitions):
    rng = np.random.default_rng(partitions)
    p = pd.DataFrame({"k": range(500), "g": ["hot"] * 400 + ["cold"] * 100, "v": np.where(rng.random(500) < 0.4, 1, rng.integers(1, 50, 500))})
    df = spark.createDataFrame(p)
    got = running_total(df, [F.col("v").desc(), F.col("k")], "v", partitions=partitions).toPandas().sort_values("k")
    p = p.sort_values(["v", "k"], ascending=[False, True])
    p["want"] = p["v"].cumsum()
    assert got["running"].tolist() == p.sort_values("k")["want"].tolist()
    assert set(got["running_all"]) == {p["v"].sum()}
    by = running_total(df, [F.col("k")], "v", within=("g",), partitions=partitions).toPandas().sort_values("k")
    assert by["running"].tolist() == p.sort_values("k").groupby("g")["v"].cumsum().tolist()


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"a": rng.normal(size=101), "b": rng.integers(0, 4, 101), "c": [None, 2.0] + [7.0] * 99})
    got = profile.describe_numeric(spark.createDataFrame(p)).toPandas().set_index("column")
    want = p.describe().T
    for ours, theirs in zip(("count", "mean", "std", "min", "q25", "q50", "q75", "max"), want.columns):
        np.testing.assert_allclose(got.loc[["a", "b", "c"], ours].astype(float), want[theirs], atol=1e-9, err_msg=ours)


def test_describe_one_row(spark):
    r = profile.describe_numeric(spark.createDataFrame([(5,)], "a int")).collect()[0]
    assert (r["count"], r["mean"], r["std"], r.q25, r.q75) == (1, 5.0, None, 5.0, 5.0)


def test_frequencies_and_profiles(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), ("y", None), (None, 5)], "s string, n int")
    assert {tuple(r) for r in profile.value_counts(df, "s").collect()} == {("x", 2), ("y", 2)}
    assert {tuple(r) for r in profile.distinct_counts(df).collect()} == {("s", 2), ("n", 3)}
    assert {tuple(r) for r in profile.null_counts(df).collect()} == {("s", 1), ("n", 1)}
    assert profile.duplicate_rows(df).collect()[0][0] == 1
    assert profile.duplicate_rows(df.limit(0)).collect()[0][0] == 0
    assert tuple(profile.describe_categorical(df, ["s"]).collect()[0]) == ("s", 4, 2, "x", 2)
    p = {r.column: r for r in profile.column_profile(df).collect()}
    assert (p["n"].n_rows, p["n"].n_null, p["n"].n_distinct, p["n"].min, p["n"].max, p["n"].top) == (5, 1, 3, 1.0, 5.0, "1")
    assert p["n"]["mean"] == 2.25 and p["n"]["std"] == pytest.approx(np.std([1, 1, 2, 5], ddof=1))
    assert p["s"]["mean"] is None and p["s"].top == "x"
    assert profile.shape(df).collect()[0] == (5, 2) and profile.numeric_columns(df) == ["n"]
    assert [r.is_numeric for r in profile.schema_rows(df).collect()] == [False, True]
    assert {tuple(r) for r in profile.histogram(df, "n", 2.0).collect()} == {(0, 0.0, 2), (1, 2.0, 1), (2, 4.0, 1)}


def test_numbers_close_together_and_far_from_zero_keep_their_spread(spark):
    df = spark.createDataFrame([(1e9,), (1e9 + 1,), (1e9 + 2,)], "a double")
    assert profile.describe_numeric(df).collect()[0]["std"] == pytest.approx(1.0)
    assert profile.column_profile(df).collect()[0]["std"] == pytest.approx(1.0)


def test_long_ids_are_described_exactly(spark):
    ids = [2 ** 53 + k for k in (0, 1, 3)]
    r = profile.describe_numeric(spark.createDataFrame([(i,) for i in ids], "id bigint"), exact=True).collect()[0]
    assert (int(r["min"]), int(r["max"])) == (ids[0], ids[-1]) and int(r["q50"]) == ids[1] and r["std"] == pytest.approx(np.std([0, 1, 3], ddof=1))


def test_pareto_at_the_boundary(spark):
    rows = profile.pareto(spark.createDataFrame([(k, 3) for k in range(95)], "product_id int, n bigint"), "product_id")
    assert profile.concentration(rows).collect()[0].n_needed == 76


def test_no_history_gives_no_products(spark, series):
    empty = series({1: [None]})
    items = spark.createDataFrame([], f"{CENTER} bigint, product_id bigint, created_at timestamp")
    last = planning.history_of(empty)[1]
    assert last is None and planning.product_mix(items, empty, last).count() == 0
    grain = empty.withColumn("product_id", F.lit(1))
    assert planning.mix_of_days(grain, empty, last).count() == 0
    assert planning.recent_average(empty, KEYS, history=(None, None)).count() == 0


def test_forecast_starts_at_the_cutoff(series):
    demand = series({1: [5, 6] * 50})
    cfg = ForecastConfig(cutoff=day("2023-03-20"), valid_from=day("2023-02-15"), test_from=day("2023-03-01"))
    assert planning.two_week_demand(demand, cfg).collect()[0].first_day == day("2023-03-20")


def test_pareto(spark):
    counts = spark.createDataFrame([(1, 50), (2, 30), (3, 10), (4, 10)], "product_id int, n bigint")
    rows = profile.pareto(counts, "product_id")
    assert [(r.product_id, r.running) for r in rows.orderBy("running").collect()] == [(1, 50), (2, 80), (3, 90), (4, 100)]
    c = profile.concentration(rows).collect()[0]
    assert (c.n_needed, c.n_keys, c.needed_share) == (2, 4, 0.5)


def test_safety_stock_and_order_quantity(series):
    demand = series({1: [5] * 100 + [10] * 90, 2: [7] + [None] * 189, 3: [None] * 189 + [90]})
    got = {r[CENTER]: r for r in planning.order_quantity(demand, KEYS).collect()}
    assert got[1].avg_qty == 10 and got[1].safety_stock == 70 and got[1].order_qty == 740
    assert got[2].avg_qty == 0 and got[2].order_qty == 0
    assert got[3].avg_qty == 1 and got[3].order_qty == 74
    short = planning.recent_average(series({1: [3, None, 6]}), KEYS).collect()[0]
    assert short.avg_qty == 3


def test_months_back_clips_to_month_end():
    assert planning._months_back(day("2024-05-31"), 3) == day("2024-02-29")
    assert planning._months_back(day("2024-01-15"), 3) == day("2023-10-15")
    assert planning._months_back(day("2024-03-31"), 3) == day("2023-12-31")
    assert planning._months_back(day("2024-12-31"), 1) == day("2024-11-30")


def test_mix_adds_up_and_scales(spark, series):
    items = spark.createDataFrame(
        [(p, d, 1) for p, d in ((1, "2024-03-31"), (1, "2024-03-30"), (2, "2024-01-01"), (3, "2023-12-31"))],
        f"product_id int, created_at string, {CENTER} bigint").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    from tidecast.operators.daily import daily_demand
    demand = daily_demand(items)
    mix = planning.product_mix(items, demand, planning.history_of(demand)[1])
    assert {(r.product_id, r.units): r.mix for r in mix.collect()} == {(1, 2): pytest.approx(2 / 3), (2, 1): pytest.approx(1 / 3)}
    units = spark.createDataFrame([(1, 30.0)], f"{CENTER} bigint, units double")
    assert {r.product_id: r.expected_units for r in planning.product_demand(mix, units).collect()} == {
        1: pytest.approx(20), 2: pytest.approx(10)}


def test_two_week_demand_of_a_constant_series(series):
    cfg = ForecastConfig(cutoff=None)
    r = planning.two_week_demand(series({1: [6] * 80}), cfg).collect()[0]
    assert r.units == pytest.approx(84) and r.first_day == day("2023-03-22")


def test_other_lags_and_horizons(series):
    cfg = ForecastConfig(cutoff=None, lags=5, horizons=3)
    r = planning.two_week_demand(series({1: [6] * 40}), cfg).collect()[0]
    assert r.units == pytest.approx(18) and r.first_day == day("2023-02-10")


def test_united_sketches_stay_within_their_bound(spark):
    """Values that repeat over groups count once in the union; a smaller sketch has a larger bound and keeps to it."""
    rows = spark.range(60_000).select((F.col("id") % 7).alias("load"), (F.col("id") * 13 % 20_000).alias("many"), (F.col("id") % 3).alias("few"),
                                      F.when(F.col("id") < 0, "x").alias("none"), F.concat(F.lit("é"), (F.col("id") % 5_000).cast("string")).alias("text"))
    exact = {r["column"]: r["n_distinct"] for r in profile.distinct_counts(rows.drop("load")).collect()}
    for size in (8, sketches.REGISTERS_LOG):
        kept = sketches.distinct_sketches(rows, by=("load",), registers_log=size)
        got = {r["column"]: r["n_distinct"] for r in sketches.united_counts(kept).collect()}
        assert set(got) == set(exact) and got["none"] == 0 and got["few"] == 3
        assert all(abs(got[c] - n) <= sketches.error_bound(size) * n + 1 for c, n in exact.items())
    assert sketches.error_bound(8) > sketches.error_bound() and sketches.error_bound() < 0.04


def test_quantiles_of_united_sketches_stay_within_their_rank_error(spark):
    """Sorted, skewed and hot columns; a load that comes twice replaces its sketch; columns without values have none."""
    rows = spark.range(70_000).select(
        (F.col("id") % 7).alias("load"), F.col("id").alias("rising"), F.exp(F.col("id") % 1_000 / 100).alias("skewed"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100).alias("hot"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id") % 10).cast("double").alias("half"))
    for size in (100, sketches.QUANTILE_SIZE):
        kept = sketches.quantile_sketches(rows, by=("load",), size=size)
        assert kept.count() == 35
        again = kept.where("load <> 3").unionByName(sketches.quantile_sketches(rows.where("load = 3"), by=("load",), size=size))
        got = sketches.united_quantiles(again, (0.0, 0.01, 0.5, 0.99, 1.0))
        found = {(r["column"], r["p"]): (r["count"], r["value"]) for r in got.collect()}
        assert {n for (c, _), (n, _) in found.items() if c in ("rising", "skewed", "hot")} == {70_000}
        assert found["half", 0.5][0] == 35_000 and found["none", 0.5] == (0, None)
        assert found["rising", 0.0][1] == 0 and found["rising", 1.0][1] == 69_999 and found["hot", 0.0][1] == 0
        errors = sketches.rank_errors(rows, got).collect()
        assert len(errors) == 20 and max(r["error"] for r in errors) <= sketches.rank_error_bound(size)
    assert sketches.rank_error_bound() < 0.01 < sketches.rank_error_bound(100)
    assert sketches.united_quantiles(sketches.quantile_sketches(rows.limit(0)), (0.5,)).where("value IS NOT NULL").count() == 0
