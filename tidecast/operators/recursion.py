"""Recursive forecasting: predict a day, make it the newest lag, repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import DATE, STEP, ForecastConfig, lag_name, step_lag_name
from tidecast.functions.calendar import calendar_columns, holiday_columns
from tidecast.operators.features import known_days, recent_quantities
from tidecast.staging import stage

STATE = "recent"  # the last quantities of a series, newest first


def series_state(demand: DataFrame, cfg: ForecastConfig, step_first: int = 1) -> DataFrame:
    """(series, date, day_step, recent): one row per series at the last day of the table, with its
    latest quantities in an array of fixed length."""
    last = recent_quantities(known_days(demand, cfg), cfg.series, cfg.lags)
    return last.select(*cfg.series, DATE, (F.col("n_days") + (step_first - 1)).cast("bigint").alias(STEP),
                       F.col("recent").cast("array<double>").alias(STATE))


def next_day_columns(cfg: ForecastConfig) -> dict[str, Column]:
    """Feature columns of a day whose ``date`` and ``day_step`` are set, by the rules of training."""
    columns = {}
    for i in range(1, cfg.lags + 1):
        columns[lag_name(i)] = F.col(STATE)[i - 1]
        columns[step_lag_name(i)] = F.col(STEP) - i
    return {**columns, **calendar_columns(F.col(DATE)), **holiday_columns(F.col(DATE), cfg.state_holidays)}


def next_day_features(state: DataFrame, cfg: ForecastConfig, columns: dict[str, Column] | None = None) -> DataFrame:
    """The feature row of the day after ``date``."""
    tomorrow = state.withColumns({DATE: F.date_add(DATE, 1), STEP: F.col(STEP) + 1})
    return tomorrow.withColumns(columns or next_day_columns(cfg))


def recursive_forecast(state: DataFrame, predict: Callable[[DataFrame, int], DataFrame], cfg: ForecastConfig) -> DataFrame:
    """(series, horizon, date, yhat) for the ``cfg.horizons`` days after the end of each series.

    ``predict(features, round)`` adds ``prediction``. The rounds are a driver loop over plans; the
    data stays distributed, one row per series. Each round is staged: its state enters the next
    round's features many times over, so a plan of unstaged rounds would grow exponentially.
    """
    columns = next_day_columns(cfg)
    current = state.withColumn("path", F.array().cast("array<double>"))
    for step in range(1, cfg.horizons + 1):
        predicted = predict(next_day_features(current, cfg, columns), step)
        current = predicted.select(
            *cfg.series, DATE, STEP,
            F.concat(F.array(F.col("prediction")), F.slice(STATE, 1, cfg.lags - 1)).alias(STATE),
            F.concat("path", F.array(F.col("prediction"))).alias("path"),
        )
        if step < cfg.horizons:
            current = stage(current, "forecast")
    return current.select(*cfg.series, DATE, F.posexplode("path").alias("pos", "yhat")).select(
        *cfg.series, (F.col("pos") + 1).alias("horizon"),
        F.date_add(DATE, F.col("pos") - (cfg.horizons - 1)).alias(DATE), "yhat")
