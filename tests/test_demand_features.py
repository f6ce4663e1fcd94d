import datetime as dt
from dataclasses import replace

import pandas as pd
import pytest
from conftest import day
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast.config import CENTER, CENTER_NAME, DATE, QTY, STEP, ForecastConfig, lag_names, quoted, target_names
from tidecast.operators import daily, features as feat
from tidecast.operators.densify import align_to_calendar, backfill, densify
from tidecast.operators.splits import SPLIT, ordered_holdout, with_split

KEYS = (CENTER,)
OPEN = ForecastConfig(cutoff=None)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*[F.col(quoted(c)) for c in columns]).collect())


def test_null_center_is_dropped_and_statuses_filter(spark):
    items = spark.createDataFrame([
        (1, "Complete", dt.datetime(2024, 1, 1, 5), 1), (2, "Cancelled", dt.datetime(2024, 1, 1, 6), 1),
        (3, None, dt.datetime(2024, 1, 1, 7), 1), (4, "Complete", dt.datetime(2024, 1, 1, 8), None),
    ], f"id int, status string, created_at timestamp_ntz, {CENTER} bigint")
    assert rows(daily.daily_demand(items), CENTER, QTY) == [(1, 3)]
    cfg = replace(OPEN, exclude_statuses=("Cancelled",))
    assert rows(daily.daily_demand(items, cfg=cfg), CENTER, QTY) == [(1, 2)]
    assert daily.daily_demand(items, cfg=replace(OPEN, centers=(2, 3))).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string"])
def test_cutoff_is_exclusive_for_every_type(spark, kind):
    text = spark.createDataFrame([("2024-02-15 23:59:59",), ("2024-02-16 00:00:00",)], "t string")
    df = text.select(F.col("t").cast(kind).alias("created_at"), F.lit(1).cast("bigint").alias(CENTER))
    assert rows(daily.daily_demand(df, cfg=ForecastConfig()), DATE, QTY) == [(day("2024-02-15"), 1)]
    assert daily.since(df, "created_at", day("2024-02-16")).count() == 1


def test_trailing_gap_keeps_own_name(spark, series):
    demand = series({1: [3, 4, None], 2: [None, 5, 6]})
    dense = densify(demand, KEYS)
    assert rows(dense, CENTER, DATE, QTY) == [
        (1, day("2023-01-01"), 3), (1, day("2023-01-02"), 4), (1, day("2023-01-03"), 0),
        (2, day("2023-01-01"), 0), (2, day("2023-01-02"), 5), (2, day("2023-01-03"), 6)]
    names = spark.createDataFrame([(1, "Memphis TN"), (2, "Chicago IL")], f"{CENTER} bigint, {CENTER_NAME} string")
    named = daily.with_attributes(dense, names)
    assert named.where(f"{CENTER} = 1").select(CENTER_NAME).distinct().collect()[0][0] == "Memphis TN"
    assert named.count() == 6


def test_backfill_stays_inside_its_series(spark):
    df = spark.createDataFrame([
        (1, day("2023-01-01"), None), (1, day("2023-01-02"), "a"), (1, day("2023-01-03"), None),
        (2, day("2023-01-01"), None), (2, day("2023-01-02"), "b")], f"{CENTER} bigint, {DATE} date, name string")
    out = backfill(df, KEYS, ["name"]).orderBy(CENTER, DATE).collect()
    assert [r.name for r in out] == ["a", "a", None, "b", "b"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(1, 4), st.lists(st.one_of(st.none(), st.integers(1, 9)), min_size=1, max_size=40),
                       min_size=1, max_size=4))
def test_densify_and_lags_match_pandas(spark, series, quantities):
    if not any(q is not None for qs in quantities.values() for q in qs):
        return
    demand = series(quantities)
    got = feat.with_qty_lags(densify(demand, KEYS), KEYS, 3).toPandas()
    pdf = demand.toPandas()
    grid = pd.MultiIndex.from_product([pdf[CENTER].unique(), pd.date_range(pdf[DATE].min(), pdf[DATE].max())],
                                      names=[CENTER, DATE])
    pdf[DATE] = pd.to_datetime(pdf[DATE])
    want = pdf.set_index([CENTER, DATE]).reindex(grid, fill_value=0).reset_index().sort_values([CENTER, DATE])
    for i in range(1, 4):
        want[f"qty_D-{i}"] = want.groupby(CENTER)[QTY].shift(i)
    got[DATE] = pd.to_datetime(got[DATE])
    got = got.sort_values([CENTER, DATE]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want.reset_index(drop=True), check_dtype=False)


def test_one_series_by_calendar_join(spark, series):
    demand = series({1: [3, None, 5]})
    days = spark.sql("select explode(sequence(date'2023-01-01', date'2023-01-03')) as date")
    assert rows(align_to_calendar(demand.select(DATE, QTY), days), DATE, QTY) == rows(densify(demand, KEYS), DATE, QTY)


def test_steps_and_their_lags(series):
    demand = series({1: [1, 2, 3], 2: [4, 5, 6]})
    one = feat.with_step_lags(feat.with_day_step(demand, KEYS), 2)
    assert rows(one, CENTER, STEP, "day_step_D-1", "day_step_D-2") == [
        (c, s, s - 1 if s > 1 else None, s - 2 if s > 2 else None) for c in (1, 2) for s in (1, 2, 3)]
    zero = feat.with_step_lags(feat.with_day_step(demand, KEYS, first=0), 1, first=0)
    assert [r[1:] for r in rows(zero.where(f"{CENTER} = 1"), CENTER, STEP, "day_step_D-1")] == [(0, None), (1, 0), (2, 1)]


def test_targets_start_on_the_same_day(series):
    r = feat.with_targets(series({1: list(range(1, 20))}), KEYS).orderBy(DATE).collect()
    assert [r[0][t] for t in target_names()] == list(range(1, 15))
    assert r[5]["y_D+14"] == 19 and r[6]["y_D+14"] is None


def test_row_chain_of_one_series(series):
    """45 days → 31 with lags → 18 with lags and targets."""
    demand = series({1: [50 + i % 7 for i in range(45)]})
    assert feat.base_features(demand, OPEN).count() == 31
    assert feat.base_features(demand, OPEN, targets=True, within_split=False).count() == 18


def test_own_range_leaves_other_series_alone(series):
    demand = series({1: [4, None, 5], 2: [None, 7]}).unionByName(series({3: [1]}, "2030-01-01"))
    days = {}
    for r in densify(demand, (CENTER,), own_range=True).orderBy(DATE).collect():
        days.setdefault(r[CENTER], []).append(r[QTY])
    assert days == {1: [4, 0, 5], 2: [7], 3: [1]}


def test_short_series_gives_no_rows(series):
    assert feat.base_features(series({1: [1] * 10}), OPEN, targets=True).count() == 0


def test_template_columns_and_values(series, cfg):
    demand = series({1: [1 + i % 9 for i in range(420)]})
    frame = feat.template_features(demand, cfg)
    lag_pairs = [n for i in range(1, 15) for n in (f"qty_D-{i}", f"day_step_D-{i}")]
    assert set(frame.columns) == {CENTER, DATE, QTY, STEP, *lag_pairs, "year", "month", "day", "week_of_year",
                                  "day_of_week", "is_national_holiday", "is_state_holiday", "is_holiday", "year_freq", SPLIT}
    r = frame.where(F.col(DATE) == day("2023-07-04")).collect()[0]
    assert (r.is_national_holiday, r.is_state_holiday, r.is_holiday, r.day_of_week, r.week_of_year) == (1, 0, 1, 1, 27)
    assert r[STEP] == 184 and r["day_step_D-14"] == 170 and r["qty_D-1"] == 1 + 183 % 9
    # Train rows of 2023 are Jan 15 … Oct 31; 2024 is never seen in training.
    assert {(r.year, r.year_freq) for r in frame.select("year", "year_freq").distinct().collect()} == {(2023, 290), (2024, 0)}


def test_per_split_features_lose_the_first_days_of_each_split(series, cfg):
    demand = series({1: [5] * 500}, "2022-12-01")
    whole = feat.template_features(demand, cfg)
    each = feat.template_features(demand, replace(cfg, per_split=True, year_freq_fit_on="split"))
    size = {r[SPLIT]: r["count"] for r in each.groupBy(SPLIT).count().collect()}
    # 14 rows less in each split; a test split of 15 days keeps one row.
    assert size == {"train": 335 - 14, "valid": 92 - 14, "test": 1}
    assert whole.where("split = 'test'").count() == 15
    assert {(r[SPLIT], r.year, r.year_freq) for r in each.select(SPLIT, "year", "year_freq").distinct().collect()} == {
        ("train", 2022, 17), ("train", 2023, 304), ("valid", 2023, 47), ("valid", 2024, 31), ("test", 2024, 1)}


def test_no_leak_from_later_days(series, cfg):
    base = [1 + i % 5 for i in range(400)]
    changed = base[:304] + [q + 7 for q in base[304:]]
    before = F.col(DATE) < F.lit(cfg.valid_from)
    a, b = (feat.template_features(series({1: q}), cfg, targets=True).where(before) for q in (base, changed))
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # The last train rows are those whose fourteenth target is still in train.
    assert a.agg(F.max(DATE)).first()[0] == day("2023-10-18")


def test_split_labels_and_holdouts(series, cfg):
    labelled = with_split(series({1: [1] * 500}, "2023-01-01"), cfg)
    bounds = {r[SPLIT]: (r.lo, r.hi) for r in labelled.groupBy(SPLIT).agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi")).collect()}
    assert bounds == {"train": (day("2023-01-01"), day("2023-10-31")), "valid": (day("2023-11-01"), day("2024-01-31")),
                      "test": (day("2024-02-01"), day("2024-02-15"))}
    two = series({1: list(range(10)), 2: list(range(7))})
    held = ordered_holdout(two, KEYS, 0.25).where("part = 'test'")
    assert rows(held, CENTER, QTY) == [(1, 7), (1, 8), (1, 9), (2, 5), (2, 6)]  # ceil(2.5), ceil(1.75)
    assert ordered_holdout(two, KEYS, 3).where("part = 'test'").count() == 6
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            ordered_holdout(two, KEYS, bad)


def test_ends_last_next_and_future(series):
    demand = series({1: list(range(1, 21)), 2: list(range(101, 121))})
    ends = feat.ends_of_series(demand, KEYS, 14)
    assert ends.count() == 56 and ends.where(f"end = 'first' and {CENTER} = 1").agg(F.max(QTY)).first()[0] == 14
    assert rows(feat.last_row(demand, KEYS), CENTER, QTY) == [(1, 20), (2, 120)]
    assert rows(feat.next_day(demand, KEYS), "next_date") == [(day("2023-01-21"),)] * 2
    future = feat.future_rows(demand, OPEN).where(f"{CENTER} = 1").collect()[0]
    assert future[DATE] == day("2023-01-21") and future[STEP] == 21
    assert [future[n] for n in lag_names()] == list(range(20, 6, -1))


def test_scaled_and_log_target(series):
    df = feat.scaled_target(feat.log_target(series({1: [1, 2, 3, 6]})))
    p = df.toPandas()
    assert p["qty_scaled"].mean() == pytest.approx(0) and p["qty_scaled"].std(ddof=0) == pytest.approx(1)
    assert p["qty_log1p"].max() == pytest.approx(1.9459101490553132)
    assert feat.scaled_target(series({1: [4, 4]})).collect()[0].qty_scaled == 0


def test_config_is_checked():
    with pytest.raises(ValueError):
        ForecastConfig(year_freq_fit_on="test")
    with pytest.raises(ValueError):
        ForecastConfig(valid_from=day("2024-03-01"))
