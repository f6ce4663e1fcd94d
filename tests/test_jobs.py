"""From CSV files to saved predictions, as a user runs it."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.config import CENTER, DATE, QTY, BoostParams, ForecastConfig
from tidecast.operators.features import base_features, multi_center_features, template_features
from tidecast.operators.linear import fit_linear
from tidecast.plans import jobs
from tidecast.sources.loader import load_data

CFG = ForecastConfig(boost=BoostParams(n_estimators=2, eta=0.5, max_depth=2, subsample=1.0, colsample=1.0))


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    rng = np.random.default_rng(5)
    days = pd.date_range("2022-12-01", "2024-02-20")
    # Product 10 carries most of the demand; product 99 is in no product file.
    product = rng.choice([10, 11, 20, 99], size=6000, p=[0.6, 0.1, 0.25, 0.05])
    stamps = rng.choice(days, size=6000) + pd.to_timedelta(rng.integers(0, 86_400, 6000), unit="s")
    items = pd.DataFrame({
        "id": range(6000), "order_id": range(6000), "user_id": 1, "product_id": product, "inventory_item_id": 2,
        "status": rng.choice(["Complete", "Cancelled"], 6000), "created_at": stamps.strftime("%Y-%m-%d %H:%M:%S UTC"),
        "shipped_at": None, "delivered_at": None, "returned_at": None, "sale_price": 1.5})
    centers = pd.DataFrame({"id": [1, 2], "name": ["Memphis TN", "Chicago IL"], "latitude": [35.1, 41.8], "longitude": [-89.9, -87.6]})
    products = pd.DataFrame({
        "id": [10, 11, 20], "cost": 1.0, "category": "Caps", "name": ["a", "b", "c"], "brand": "MG", "retail_price": 2.0,
        "department": "Women", "sku": "X", "distribution_center_id": [1, 1, 2]})
    paths = []
    for name, df in (("items", items), ("centers", centers), ("products", products)):
        paths.append(str(folder / f"{name}.csv"))
        df.to_csv(paths[-1])
    return items, paths


def expected(items, exclude=()):
    p = items[(items.product_id != 99) & ~items.status.isin(exclude)].copy()
    p[CENTER] = np.where(p.product_id == 20, 2, 1)
    p[DATE] = pd.to_datetime(p.created_at.str[:10]).dt.date
    p = p[p[DATE] < dt.date(2024, 2, 16)]
    return {(k[0], k[1]): n for k, n in p.groupby([CENTER, DATE]).size().items()}


def test_all_jobs_in_a_row(spark, sources, tmp_path):
    items, paths = sources
    tables = load_data(spark, *paths)
    demand = jobs.prepare_demand(*[tables[i] for i in (0, 2, 1)], CFG, str(tmp_path / "demand"))
    assert {(r[CENTER], r[DATE]): r[QTY] for r in demand.collect()} == expected(items)
    assert set(demand.columns) == {CENTER, DATE, QTY, "split", "distribution_center_name",
                                   "distribution_center_latitude", "distribution_center_longitude"}
    assert demand.where(f"{CENTER} = 2").select("distribution_center_name").distinct().collect()[0][0] == "Chicago IL"

    run = jobs.train_and_select(demand, CFG)
    assert run.metrics.count() == 2 and run.forecasts.count() == 2 * 2 * 14
    assert jobs.save_best(run, str(tmp_path / "best")) in (jobs.LINEAR, jobs.BOOSTED)
    test = template_features(demand, CFG).where("split = 'test'")
    predictions, errors = jobs.batch_predict(test, run.linear, CFG, str(tmp_path / "predictions"), only_with_targets=True)
    # Fifteen test days per center leave two whose fourteen target days are known.
    assert predictions.count() == 30 and predictions.where("`y_D+1` is not null").count() == 4
    assert errors.collect()[0].n == 4 * 14
    assert multi_center_features(demand, CFG).where(F.col("split") == "train").count() > 0


def test_cancelled_orders_can_be_left_out(spark, sources):
    items, paths = sources
    a, b, c = load_data(spark, *paths)
    cfg = ForecastConfig(exclude_statuses=("Cancelled",), centers=(1,))
    demand = jobs.prepare_demand(a, c, b, cfg)
    want = {k: v for k, v in expected(items, ("Cancelled",)).items() if k[0] == 1}
    assert {(r[CENTER], r[DATE]): r[QTY] for r in demand.collect()} == want


def test_shorter_lags_and_horizons(spark, sources):
    a, b, c = load_data(spark, *sources[1])
    cfg = ForecastConfig(lags=5, horizons=3, centers=(1,))
    demand = jobs.prepare_demand(a, c, b, cfg)
    rows = base_features(demand, cfg, step_lags=False, targets=True)
    model = fit_linear(rows, cfg.series, *jobs.columns_of(cfg))
    per_split = {r.split: r.n for r in jobs.linear_metrics(demand, model, cfg).collect()}
    assert per_split == {r.split: 3 * r["count"] for r in rows.groupBy("split").count().collect()}
    predictions, _ = jobs.batch_predict(multi_center_features(demand, cfg), model, cfg)
    assert "y_D+3" in predictions.columns and "y_D+4" not in predictions.columns
    assert jobs.direct_forecast(demand, model, cfg).count() == 3
