import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from conftest import day
from pyspark.sql import functions as F

from tidecast.config import CENTER, DATE, QTY, SHALLOW_BOOST, BoostParams, ForecastConfig, lag_names, quoted, target_names
from tidecast.operators import features as feat, linear, metrics as met, trees
from tidecast.operators.recursion import next_day_features, recursive_forecast, series_state
from tidecast.plans import jobs
from tidecast.sources import sinks

KEYS = (CENTER,)
OPEN = ForecastConfig(cutoff=None)
TINY = BoostParams(n_estimators=3, eta=0.5, max_depth=3, subsample=1.0, colsample=1.0, seed=1)


def noisy(n, seed=0, level=20):
    rng = np.random.default_rng(seed)
    return [int(v) for v in level + 5 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.integers(0, 6, n)]


def least_squares(p, x, y):
    a = np.column_stack([np.ones(len(p)), p[x].to_numpy(float)])
    return np.linalg.lstsq(a, p[y].to_numpy(float), rcond=None)[0]


@pytest.fixture
def xy(series):
    demand = series({1: noisy(200, 1), 2: noisy(200, 2, 60)})
    return feat.base_features(demand, OPEN, targets=True, within_split=False).cache()


def test_fit_per_series_equals_least_squares(xy):
    model = linear.fit_linear(xy, KEYS)
    for r in model.collect():
        p = xy.where(F.col(CENTER) == r[CENTER]).toPandas()
        want = least_squares(p, lag_names(), target_names())
        np.testing.assert_allclose(r.intercepts, want[0], rtol=1e-6, atol=1e-7)
        np.testing.assert_allclose(np.array(r.weights), want[1:].T, rtol=1e-6, atol=1e-8)
        assert r.n_rows == len(p)


def test_pooled_fit_and_scores(xy):
    model = linear.fit_linear(xy, ())
    want = least_squares(xy.toPandas(), lag_names(), target_names())
    r = model.collect()[0]
    np.testing.assert_allclose(r.intercepts, want[0], rtol=1e-6, atol=1e-6)
    wide = linear.score_linear(xy, model, ()).toPandas()
    fitted = np.column_stack([np.ones(len(wide)), wide[lag_names()].to_numpy(float)]) @ want
    np.testing.assert_allclose(wide[[met.prediction_name(h) for h in range(1, 15)]], fitted, rtol=1e-6)
    cells = linear.score_long(xy, model, (), [CENTER, DATE]).toPandas()
    long = wide.melt([CENTER, DATE], [met.prediction_name(h) for h in range(1, 15)], "name", "yhat")
    long["horizon"] = long["name"].str[7:].astype(int)
    both = cells.merge(long, on=[CENTER, DATE, "horizon"])
    assert len(both) == len(wide) * 14 and np.allclose(both.yhat_x, both.yhat_y)


def test_hot_series_does_not_change_the_sums(spark, xy):
    """Statistics of a series that holds nearly all rows equal those of a direct computation."""
    hot = xy.where(f"{CENTER} = 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(60)))).drop("copy")
    stats = linear.sufficient_statistics(hot.unionByName(xy.where(f"{CENTER} = 2")), KEYS, lag_names(), target_names())
    single = linear.sufficient_statistics(xy, KEYS, lag_names(), target_names()).toPandas().set_index([CENTER, "term"])
    for r in stats.collect():
        factor = 60 if r[CENTER] == 1 else 1
        np.testing.assert_allclose(r.s, np.array(single.loc[(r[CENTER], r.term), "s"]) * factor)


def test_all_zero_series_forecasts_zero(series):
    demand = series({1: [0] * 60, 2: [4] * 60})
    frame = feat.base_features(demand, OPEN, targets=True, within_split=False)
    cells = linear.score_long(frame, linear.fit_linear(frame, KEYS), KEYS, [CENTER])
    spread = {r[CENTER]: (r.lo, r.hi) for r in cells.groupBy(CENTER).agg(F.min("yhat").alias("lo"), F.max("yhat").alias("hi")).collect()}
    assert spread[1] == (0.0, 0.0) and spread[2] == (pytest.approx(4), pytest.approx(4))


def test_constant_fractions_leave_only_the_intercept(spark):
    """Rounding noise of centered sums must not pass for variation."""
    df = spark.createDataFrame([(1, 0.1 + 1e6, 0.7, float(i)) for i in range(97)], f"{CENTER} int, a double, b double, y double")
    r = linear.fit_linear(df, KEYS, ["a", "b"], ["y"]).collect()[0]
    assert r.weights == [[0.0, 0.0]] and r.intercepts == [pytest.approx(48)]


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8, -1e10])
def test_slopes_keep_far_from_zero(spark, offset):
    """y = 3x + 2z, with x and z close together far from zero, in many tasks and with a row that is not complete."""
    rng = np.random.default_rng(3)
    x, z = rng.integers(0, 50, 400).tolist(), rng.integers(0, 9, 400).tolist()
    rows = [(k % 2, offset + a, b - offset, float(3 * (offset + a) + 2 * (b - offset))) for k, (a, b) in enumerate(zip(x, z))]
    df = spark.createDataFrame(rows + [(1, 5.0, None, 7.0)], f"{CENTER} int, x double, z double, y double").repartition(9)
    for r in linear.fit_linear(df, KEYS, ["x", "z"], ["y"]).collect():
        assert r.weights[0] == pytest.approx([3, 2], abs=1e-6) and r.n_rows == 200
    assert linear.fit_linear(df, (), ["x", "z"], ["y"]).collect()[0].weights[0] == pytest.approx([3, 2], abs=1e-6)


def test_moments_merge_in_any_order_to_those_of_all_rows():
    rng = np.random.default_rng(5)
    rows = rng.normal(1e7, 3, (300, 4))
    parts = [linear.Moments.of(p, 2) for p in np.split(rows, [1, 2, 50, 51, 200])]
    for order in (parts, parts[::-1]):
        total = order[0]
        for p in order[1:]:
            total = linear.Moments.unpacked(np.array(total.merged(p).packed()), 2)
        off = rows - rows.mean(axis=0)
        assert total.n == 300 and total.products == pytest.approx(off.T @ off[:, :2], rel=1e-9, abs=1e-6) and total.mean == pytest.approx(rows.mean(axis=0))


def test_short_series_has_no_model_but_keeps_its_rows(series):
    demand = series({1: noisy(80), 2: [None] * 60 + noisy(20)})
    frame = feat.base_features(demand, OPEN, targets=True, within_split=False)
    model = linear.fit_linear(frame.where(f"{CENTER} = 1"), KEYS)
    scored = linear.score_linear(frame, model, KEYS)
    assert scored.where(f"{CENTER} = 2 and `yhat_D+1` is null").count() == frame.where(f"{CENTER} = 2").count() > 0


def test_coefficients_survive_storage(spark, xy, tmp_path):
    model = linear.fit_linear(xy, KEYS)
    sinks.save_linear(model, str(tmp_path / "model"))
    again = sinks.load_linear(spark, str(tmp_path / "model"))
    rows = linear.coefficient_rows(again, KEYS)
    assert rows.count() == 2 * 14 * 15
    assert {r.feature for r in rows.select("feature").distinct().collect()} == {"intercept", *lag_names()}
    assert linear.score_long(xy, again, KEYS, []).exceptAll(linear.score_long(xy, model, KEYS, [])).count() == 0


def test_errors_of_a_made_table_equal_numpy(spark):
    """Known coefficients score 32 days; pooled, per-output and naive errors are numpy's, and the coefficients come back."""
    rng = np.random.default_rng(8)
    qty = rng.integers(20, 90, 46)
    weights, intercepts = rng.normal(0, 0.1, (14, 14)), rng.normal(40, 5, 14)
    start, rows = day("2030-01-15"), []
    for t in range(14, 46):
        lags = qty[t - 14:t][::-1]
        rows.append({CENTER: 1, DATE: start + dt.timedelta(days=t), QTY: int(qty[t]),
                     **{f"qty_D-{i}": int(v) for i, v in enumerate(lags, 1)},
                     **{met.prediction_name(h): float(v) for h, v in enumerate(intercepts + weights @ lags, 1)}})
    df = feat.with_targets(spark.createDataFrame(pd.DataFrame(rows)), KEYS).where(F.col(quoted("y_D+14")).isNotNull())
    y = np.array([qty[t:t + 14] for t in range(14, 33)], float)
    yhat = np.array([intercepts + weights @ qty[t - 14:t][::-1] for t in range(14, 33)])
    err = np.abs(y - yhat)
    m = met.error_metrics(met.long_pairs(df, [CENTER]), [CENTER]).collect()[0]
    assert (m.mae, m.rmse, m.rmse_per_output) == pytest.approx((err.mean(), np.sqrt((err ** 2).mean()), np.sqrt((err ** 2).mean(axis=0)).mean()))
    assert m.mape == pytest.approx((err / y).mean()) and m.mape == pytest.approx(m.mape_nonzero) and m.n == y.size
    per_day = {r.h: (r.mae, r.rmse) for r in met.error_metrics(met.long_pairs(df, [CENTER]).withColumn("h", F.col("horizon")), ["h"]).collect()}
    assert per_day[7] == pytest.approx((err[:, 6].mean(), np.sqrt((err[:, 6] ** 2).mean())))
    first = met.naive_pairs(df, [CENTER], (1,)).where("horizon = 1")
    assert met.error_metrics(first, [CENTER]).collect()[0].mae == pytest.approx(np.abs(np.diff(qty)[13:32]).mean())

    predictions = [met.prediction_name(h) for h in range(1, 15)]
    fitted = linear.score_long(df, linear.fit_linear(df, KEYS, y=predictions), KEYS, [DATE], y=predictions)
    assert fitted.agg(F.max(F.abs(F.col("y") - F.col("yhat")))).first()[0] < 1e-6


def test_series_without_a_model_stay_visible(series):
    frame = feat.base_features(series({1: noisy(80), 2: [None] * 60 + noisy(20)}), OPEN, targets=True, within_split=False)
    model = linear.fit_linear(frame.where(f"{CENTER} = 1"), KEYS)
    cells = linear.score_long(frame, model, KEYS, [CENTER])
    assert cells.count() == 14 * frame.count() and cells.where("y is null or horizon is null").count() == 0
    errors = {r[CENTER]: r for r in met.error_metrics(cells, [CENTER]).collect()}
    assert {c: r.unscored for c, r in errors.items()} == {1: 0, 2: 14 * frame.where(f"{CENTER} = 2").count()}
    assert errors[2].n == 0 and errors[2].rmse is None and errors[1].rmse is not None


def test_a_model_without_an_error_does_not_win(spark):
    rows = spark.createDataFrame([("a", None), ("b", 2.0), ("c", 1.0), ("d", float("nan"))], "model string, rmse double")
    assert tuple(met.best_model(rows).collect()[0]) == ("c", 1.0)


def test_error_metrics_edge_cases(spark):
    cells = spark.createDataFrame([
        ("a", 1, 0.0, 1.0), ("a", 1, 4.0, 2.0), ("a", 2, 2.0, 12.0), ("a", 2, 2.0, 2.0), ("b", 1, 0.0, 0.0),
        ("b", 2, None, 3.0)], "model string, horizon int, y double, yhat double")
    m = {r.model: r for r in met.error_metrics(cells, ["model"]).collect()}
    a = m["a"]
    assert a.mae == 13 / 4 and a.mape > 1e14 and a.mape_nonzero == pytest.approx((0.5 + 5 + 0) / 3)
    assert a.rmse == pytest.approx(np.sqrt((1 + 4 + 100) / 4))
    assert a.rmse_per_output == pytest.approx((np.sqrt(2.5) + np.sqrt(50)) / 2) and a.rmse != a.rmse_per_output
    assert m["b"].n == 1 and m["b"].mape_nonzero is None and m["b"].rmse == 0
    assert met.best_model(met.error_metrics(cells, ["model"])).collect()[0].model == "b"


def test_best_model_tie_goes_to_the_smaller_name(spark):
    m = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "model string, rmse double")
    assert met.best_model(m).collect()[0].model == "a"


def lag_one(rows, step):
    return rows.withColumn("prediction", F.col(quoted("qty_D-1")))


def test_recursion_repeats_the_last_value(series):
    state = series_state(series({1: list(range(1, 31)), 2: [9] * 30}), OPEN)
    out = recursive_forecast(state, lag_one, OPEN).orderBy(CENTER, "horizon").collect()
    assert [r.yhat for r in out] == [30.0] * 14 + [9.0] * 14
    assert [r[DATE] for r in out[:14]] == [day("2023-01-31") + dt.timedelta(days=i) for i in range(14)]


def test_recursion_shifts_every_lag(series):
    """With a fourteen-day lag as the forecast, the path repeats the last fourteen days in order."""
    state = series_state(series({1: list(range(1, 31))}), OPEN)
    out = recursive_forecast(state, lambda d, s: d.withColumn("prediction", F.col(quoted("qty_D-14"))), OPEN)
    assert [r.yhat for r in out.orderBy("horizon").collect()] == [float(v) for v in range(17, 31)]
    twelve = recursive_forecast(state, lambda d, s: d.withColumn("prediction", F.col(quoted("qty_D-12"))), OPEN)
    assert [r.yhat for r in twelve.orderBy("horizon").collect()] == [float(v) for v in [*range(19, 31), 19, 20]]


def test_next_day_features_match_training_features(series, cfg):
    """The row a forecast builds equals the row training would build for that day."""
    q = noisy(420)
    built = next_day_features(series_state(series({1: q[:300]}), cfg, step_first=0), cfg).collect()[0]
    trained = feat.template_features(series({1: q}), cfg).where(F.col(DATE) == F.lit(built[DATE])).collect()[0]
    for c in trained.__fields__:
        if c not in (QTY, "split", "year_freq"):
            assert trained[c] == built[c], c
    for days, flag in ((("07-19",), 1), (("07-20",), 0)):
        c = replace(cfg, state_holidays=days)
        july19 = next_day_features(series_state(series({1: q[:199]}), c), c).collect()[0]
        assert str(july19[DATE]) == "2023-07-19" and july19.is_state_holiday == flag


@pytest.mark.parametrize("refit", [False, True, "warm"])
def test_recursive_boosted(series, cfg, refit):
    small = replace(cfg, horizons=3 if refit else 14)
    demand = series({1: noisy(304, 1), 2: noisy(304, 2, 60)})
    frame = feat.template_features(demand, small).cache()
    out = trees.recursive_boosted(frame, demand, feat.year_frequency(frame), small, TINY, refit).toPandas()
    assert len(out) == 2 * small.horizons and out[DATE].min() == day("2023-11-01")
    low, high = out[out[CENTER] == 1].yhat, out[out[CENTER] == 2].yhat
    assert low.between(10, 40).all() and high.between(45, 75).all()


def test_a_model_that_goes_on_is_boosting_by_more_trees(spark):
    """Each added tree is the tree of the residuals before it, counted eta times; values of rows are kept up to date."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), float(b), float(2 * a + (b > 0))) for a, b in x], "a double, b double, qty double")
    params = BoostParams(n_estimators=1, eta=0.5, max_depth=2, subsample=1.0, colsample=1.0, seed=1)
    going = trees.Continued(trees.fit_boosted(df, ["a", "b"], params), params)
    rows = going.predict(trees.assembled(df, ["a", "b"], QTY).select("features", "label"), "fitted").cache()
    errors = [rows.agg(F.avg((F.col("label") - F.col("fitted")) ** 2)).first()[0]]
    for _ in range(4):
        before = rows
        rows = going.go_on(rows, 1)
        tree = going.added[-1]
        want = {tuple(r.features): r.fitted + 0.5 * tree.predict(r.features) for r in before.collect()}
        assert {tuple(r.features): r.fitted for r in rows.collect()} == pytest.approx(want)
        leaves = {}
        for r in before.collect():
            leaves.setdefault(round(tree.predict(r.features), 9), []).append(r.label - r.fitted)
        assert all(value == pytest.approx(np.mean(left), abs=1e-6) for value, left in leaves.items())
        errors.append(rows.agg(F.avg((F.col("label") - F.col("fitted")) ** 2)).first()[0])
    assert errors == sorted(errors, reverse=True) and errors[-1] < errors[0]
    # The model's value from scratch is what the rows carry.
    again = going.predict(rows.select("features", "fitted")).collect()
    assert [r.prediction for r in again] == pytest.approx([r.fitted for r in again])


def test_boost_parameters():
    for params in (BoostParams(), SHALLOW_BOOST):
        m = trees.boosted_regressor(params)
        assert (m.getMaxIter(), m.getStepSize(), m.getMaxDepth(), m.getSubsamplingRate(), m.getSeed()) == (
            params.n_estimators, params.eta, params.max_depth, params.subsample, params.seed)
        assert float(m.getFeatureSubsetStrategy()) == params.colsample
    assert BoostParams().n_estimators == 500 and SHALLOW_BOOST.max_depth == 3


def test_appended_forecasts_join_the_history(spark):
    history = spark.createDataFrame([(1.0, 3)], "a double, qty bigint")
    longer = trees.append_rows(history, spark.createDataFrame([(2.5, 2.0)], "qty double, a double"))
    assert sorted(map(tuple, longer.select("a", "qty").collect())) == [(1.0, 3.0), (2.0, 2.5)]


def test_per_horizon_models(xy):
    models = trees.fit_per_horizon(xy, lag_names(), TINY, horizons=2)
    scored = trees.score_per_horizon(xy, lag_names(), models)
    assert "yhat_D+2" in scored.columns
    m = met.error_metrics(met.long_pairs(scored, [], 2), []).collect()[0]
    assert m.mape < 0.2 and m.n == 2 * xy.count()


def test_unseen_category_is_all_zeros(spark):
    train = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 2), ("c", 3.0, 3)] * 5, "cat string, num double, qty int")
    fresh = spark.createDataFrame([("zzz", 1.0), ("a", 1.0)], "cat string, num double")
    model, scored = trees.pooled_forest(train, fresh, ["cat"], ["num"], trees=3)
    hot = {r.cat: r.cat_hot.toArray().tolist() for r in scored.collect()}
    assert hot["zzz"] == [0.0, 0.0, 0.0] and hot["a"] == [1.0, 0.0, 0.0]
    assert scored.where("prediction is null").count() == 0 and len(model.stages) == 4


def test_importance_ranks_the_driver_first(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(float(a), float(b), float(c), float(3 * b)) for a, b, c in x], "a double, b double, c double, qty double")
    ranked = trees.feature_importance(df, ["a", "b", "c"], trees=10).collect()
    assert ranked[0].feature == "b" and sum(r.importance for r in ranked) == pytest.approx(1)


def test_training_compares_on_the_same_days(series, cfg, spark, tmp_path):
    demand = series({1: noisy(411, 1), 2: noisy(411, 2, 60)})
    run = jobs.train_and_select(demand, cfg, TINY, runs=str(tmp_path / "runs"))
    recorded = {r.model: r for r in sinks.load_runs(spark, str(tmp_path / "runs")).collect()}
    assert recorded["boosted_recursive"].params["n_estimators"] == str(TINY.n_estimators) and recorded["linear"].metrics["n"] == 28
    m = {r.model: r for r in run.metrics.collect()}
    assert {k: r.n for k, r in m.items()} == {"linear": 28, "boosted_recursive": 28}
    assert run.best.collect()[0].model == min(m, key=lambda k: m[k].rmse)
    assert {r[DATE] for r in run.forecasts.select(DATE).distinct().collect()} == {
        day("2023-11-01") + dt.timedelta(days=i) for i in range(14)}

    winner = jobs.save_best(run, str(tmp_path / "best"))
    assert jobs.load_best(spark, str(tmp_path / "best"))[0] == winner
    swapped = replace(run, best=spark.createDataFrame([("boosted_recursive", 1.0)], "model string, rmse double"))
    jobs.save_best(swapped, str(tmp_path / "best"))
    name, model = jobs.load_best(spark, str(tmp_path / "best"))
    assert name == "boosted_recursive" and model.model.getNumTrees == TINY.n_estimators
    assert model.features == trees.tree_features(cfg) and model.state_holidays == cfg.state_holidays
    with pytest.raises(ValueError):
        jobs.save_best(replace(swapped, boosted=None), str(tmp_path / "none"))

    features = feat.template_features(demand, cfg).where("split <> 'train'")
    # The saved trees score the day after the training history as they did in training.
    again, errors = jobs.batch_predict(features, model, cfg)
    first = again.where(F.col(DATE) == F.lit(cfg.valid_from)).orderBy(CENTER).collect()
    made = run.forecasts.where("model = 'boosted_recursive'").orderBy(CENTER, "horizon").collect()
    assert [r[f"y_D+{h}"] for r in first for h in range(1, 15)] == pytest.approx([r.yhat for r in made])
    assert errors.collect()[0].n == 14 * (features.count() - 26)

    predictions, errors = jobs.batch_predict(features, run.linear, cfg, str(tmp_path / "predictions"), only_with_targets=True)
    assert predictions.count() == features.count() and QTY not in predictions.columns
    # Rows without all fourteen known targets keep their features and carry no prediction.
    assert predictions.where("`y_D+1` is null").count() == 2 * 13 == predictions.where("`y_D+14` is null").count()
    assert errors.collect()[0].n == 14 * (features.count() - 26)
    everything, _ = jobs.batch_predict(features, run.linear, cfg)
    assert everything.where("`y_D+14` is null").count() == 0
