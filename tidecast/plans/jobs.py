"""The three jobs of a forecast: prepare demand, train and select, score in batch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.config import CENTER, DATE, STEP, BoostParams, ForecastConfig, lag_names, quoted, target_name, target_names
from tidecast.operators.daily import attach_products, daily_demand, with_attributes
from tidecast.operators.densify import densify
from tidecast.operators.features import base_features, future_rows, template_features, with_targets, year_frequency
from tidecast.operators.linear import fit_linear, score_linear, score_long
from tidecast.operators.metrics import best_model, error_metrics, forecast_vs_actual, long_pairs, prediction_name
from tidecast.operators.recursion import STATE, recursive_forecast
from tidecast.operators.splits import SPLIT, with_split
from tidecast.operators.trees import fit_boosted, known_frequency, recursive_boosted, tree_features, vector_of
from tidecast.sources.models import Manifest, find, publish
from tidecast.sources.sinks import load_linear, record_run, save_linear, save_splits, save_table
from tidecast.staging import stage

LINEAR, BOOSTED = "linear", "boosted_recursive"


def columns_of(cfg: ForecastConfig) -> tuple[list[str], list[str]]:
    """Inputs and targets of the linear model."""
    return lag_names(cfg.lags), target_names(cfg.horizons)


def prepare_demand(items: DataFrame, products: DataFrame, centers: DataFrame, cfg: ForecastConfig,
                   path: str | None = None) -> DataFrame:
    """Loaded sources to daily demand with the attributes of its center, labelled by split.

    Written by split when a path is given. Items meet only the product's center id before the
    count; the attributes follow after it.
    """
    placed = attach_products(items, products.select("product_id", CENTER))
    demand = with_split(daily_demand(placed, cfg.series, cfg), cfg)
    if CENTER in cfg.series:
        demand = with_attributes(demand, centers)
    if path:
        save_splits(demand, path)
        return demand.sparkSession.read.parquet(path)
    return stage(demand, "demand")


def direct_forecast(demand: DataFrame, model: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """(series, horizon, date, yhat) of the linear model for the days after ``demand`` ends."""
    start = future_rows(demand, cfg)
    cells = score_long(start, model, cfg.series, [*cfg.series, DATE], lag_names(cfg.lags), [])
    return cells.select(*cfg.series, "horizon", F.date_add(DATE, F.col("horizon") - 1).alias(DATE), "yhat")


def split_errors(rows: DataFrame, model: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Errors of a linear model per split of a frame with lags and targets."""
    cells = score_long(rows, model, cfg.series, [SPLIT], *columns_of(cfg))
    return error_metrics(cells, [SPLIT]).select(F.lit(LINEAR).alias("model"), "*")


def linear_metrics(demand: DataFrame, model: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Errors of a linear model per split over all rows with known targets."""
    return split_errors(base_features(demand, cfg, step_lags=False, targets=True), model, cfg)


@dataclass
class Training:
    linear: DataFrame     # coefficients, one row per series
    forecasts: DataFrame  # (model, series, horizon, date, yhat) for the first days of validation
    metrics: DataFrame    # (model, n, mae, …) on exactly those days
    best: DataFrame       # (model, rmse)
    boosted: BoostedModel | None  # None when it was trained anew each round
    cfg: ForecastConfig


@dataclass
class LinearModel:
    """Coefficients of a saved linear model, one row per series, and what they were fitted for."""

    coefficients: DataFrame
    manifest: Manifest


@dataclass
class BoostedModel:
    """Boosted trees with all it takes to score: feature order, year frequencies, state holidays."""

    model: GBTRegressionModel
    features: list[str]
    frequency: DataFrame
    state_holidays: tuple[str, ...]
    manifest: Manifest | None = None

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/trees")
        spark = self.frequency.sparkSession
        settings = [("feature", k, c) for k, c in enumerate(self.features)] + [("state_holiday", k, d) for k, d in enumerate(self.state_holidays)]
        save_table(spark.createDataFrame(settings, "kind string, position int, value string"), f"{path}/settings")
        save_table(self.frequency.select("year", "year_freq"), f"{path}/year_freq")

    @staticmethod
    def load(spark: SparkSession, path: str, manifest: Manifest | None = None) -> BoostedModel:
        rows = spark.read.parquet(f"{path}/settings").orderBy("position").collect()  # one row per feature and holiday
        pick = lambda kind: [r["value"] for r in rows if r["kind"] == kind]
        return BoostedModel(GBTRegressionModel.load(f"{path}/trees"), pick("feature"), spark.read.parquet(f"{path}/year_freq"), tuple(pick("state_holiday")), manifest)

    def predictor(self) -> Callable[[DataFrame, int], DataFrame]:
        year_freq, vector = known_frequency(self.frequency), vector_of(self.features)
        return lambda rows, step: self.model.transform(rows.withColumn("year_freq", year_freq).withColumn("features", vector)).drop("features")


def train_and_select(demand: DataFrame, cfg: ForecastConfig, boost: BoostParams | None = None,
                     refit: bool = False, runs: str | None = None) -> Training:
    """Fits both models on the train split and compares them on the same validation days.

    Actual days come from the filled history, so days without demand count as zero. With ``runs``
    (a path) each model's settings and errors are appended to the table of runs. Models that
    left different numbers of days unscored are not comparable, which is an error.
    """
    train = demand.where(F.col(DATE) < F.lit(cfg.valid_from))
    linear = stage(fit_linear(
        base_features(demand, cfg, step_lags=False, targets=True).where(F.col(SPLIT) == "train"),
        cfg.series, *columns_of(cfg)), "linear")
    # The feature table of the train days alone: what it was encoded with is what the forecast uses.
    frame = stage(template_features(train, cfg), "train")
    trees = None if refit else fit_boosted(frame, tree_features(cfg), boost or cfg.boost)
    boosted = stage(recursive_boosted(frame, train, year_frequency(frame), cfg, boost, refit, trees), "boosted")

    columns = [*cfg.series, "horizon", DATE, "yhat"]
    forecasts = direct_forecast(train, linear, cfg).select(F.lit(LINEAR).alias("model"), *columns).unionByName(
        boosted.select(F.lit(BOOSTED).alias("model"), *columns))
    pairs = forecast_vs_actual(forecasts, densify(demand, cfg.series), cfg.series)
    metrics = stage(error_metrics(pairs, ["model"]), "metrics")
    errors = {r["model"]: r.asDict() for r in metrics.collect()}  # a row per model
    if len({r["n"] for r in errors.values()}) > 1:
        raise ValueError(f"the models were scored on different cells: { {k: r['n'] for k, r in errors.items()} }")
    kept = BoostedModel(trees, tree_features(cfg), year_frequency(frame), cfg.state_holidays) if trees else None
    for name, params in ((LINEAR, {"lags": cfg.lags, "horizons": cfg.horizons}), (BOOSTED, asdict(boost or cfg.boost))) if runs else ():
        found = {k: float(v) for k, v in errors.get(name, {}).items() if k != "model" and v is not None}
        record_run(demand.sparkSession, runs, f"{name}-{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S}", name, params, found, {"refit": str(refit), "valid_from": str(cfg.valid_from)})
    return Training(linear, forecasts, metrics, best_model(metrics), kept, cfg)


def inputs_of(kind: str, cfg: ForecastConfig) -> list[str]:
    """The feature columns of a kind of model, in the order it takes them."""
    return lag_names(cfg.lags) if kind == LINEAR else tree_features(cfg)


def save_best(run: Training, path: str) -> str:
    """Saves the winning model as the next version under ``path`` and returns its name; the name is data, not a file name."""
    name = run.best.first()["model"]
    if name == BOOSTED and run.boosted is None:
        raise ValueError("a model trained anew each round leaves no single model to save")
    write = (lambda folder: save_linear(run.linear, f"{folder}/model")) if name == LINEAR else (lambda folder: run.boosted.save(f"{folder}/model"))
    publish(run.linear.sparkSession, path, Manifest.of(name, run.cfg, inputs_of(name, run.cfg)), write)
    return name


def load_best(spark: SparkSession, path: str, cfg: ForecastConfig | None = None, version: int | None = None) -> tuple[str, LinearModel | BoostedModel]:
    """The newest model saved under ``path``, or that of a version; with ``cfg`` it must have been trained for these settings."""
    manifest, folder = find(spark, path, version)
    if cfg:
        manifest.check(cfg, inputs_of(manifest.kind, cfg))
    if manifest.kind == LINEAR:
        return LINEAR, LinearModel(load_linear(spark, f"{folder}/model"), manifest)
    return BOOSTED, BoostedModel.load(spark, f"{folder}/model", manifest)


def score_boosted(rows: DataFrame, best: BoostedModel, cfg: ForecastConfig) -> DataFrame:
    """Adds yhat_D+1 …: each row is forecast day by day from its own lags, as after the end of a history."""
    apart = replace(cfg, series=(*cfg.series, "__start"), state_holidays=best.state_holidays)
    state = rows.select(*cfg.series, F.col(DATE).alias("__start"), F.date_sub(DATE, 1).alias(DATE), (F.col(STEP) - 1).alias(STEP),
                        F.array(*[F.col(quoted(c)) for c in lag_names(cfg.lags)]).cast("array<double>").alias(STATE))
    cells = recursive_forecast(state, best.predictor(), apart)
    wide = cells.groupBy(*apart.series).agg(*[
        F.max(F.when(F.col("horizon") == h, F.col("yhat"))).alias(prediction_name(h)) for h in range(1, cfg.horizons + 1)])
    return rows.join(wide.withColumnRenamed("__start", DATE), [*cfg.series, DATE], "left")


def batch_predict(frame: DataFrame, model: DataFrame | LinearModel | BoostedModel, cfg: ForecastConfig, path: str | None = None,
                  only_with_targets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics) of a saved model of either kind on a feature table.

    Predictions keep every feature row under the columns y_D+1 …; with ``only_with_targets`` rows
    without a full set of known targets carry nulls. Targets and features share
    a row, so aligning them takes no join. A saved model refuses settings it was not trained for.
    """
    if not isinstance(model, DataFrame) and model.manifest:
        model.manifest.check(cfg, inputs_of(model.manifest.kind, cfg))
    if isinstance(model, LinearModel):
        model = model.coefficients
    keys = (*cfg.series, SPLIT) if cfg.per_split else cfg.series
    names = [quoted(t) for t in target_names(cfg.horizons)]
    rows = frame if target_name(1) in frame.columns else with_targets(frame, keys, cfg.horizons)
    complete = F.col(quoted(target_name(cfg.horizons))).isNotNull()
    if isinstance(model, BoostedModel):
        name, scored = BOOSTED, stage(score_boosted(rows, model, cfg), "scored")
        cells = long_pairs(scored.where(complete), [], cfg.horizons)
    else:
        name, scored = LINEAR, score_linear(rows, model, cfg.series, lag_names(cfg.lags), cfg.horizons)
        cells = score_long(rows.where(complete), model, cfg.series, [], *columns_of(cfg))
    metrics = error_metrics(cells.withColumn("model", F.lit(name)), ["model"])
    shown = {t: F.col(quoted(prediction_name(h))) for h, t in enumerate(target_names(cfg.horizons), 1)}
    if only_with_targets:
        shown = {t: F.when(complete, c) for t, c in shown.items()}
    predictions = scored.withColumns(shown).drop("qty", *[prediction_name(h) for h in range(1, cfg.horizons + 1)])
    if path:
        save_table(predictions, path)
        predictions = frame.sparkSession.read.parquet(path)
    return predictions, metrics
