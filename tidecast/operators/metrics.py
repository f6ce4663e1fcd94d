"""Forecast errors from long (…, horizon, y, yhat) rows, and the choice between models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import DATE, QTY, quoted, target_name

# Fixed value: spacing of doubles at 1, the floor of |y| in the percentage error.
EPS = 2.220446049250313e-16


def prediction_name(h: int) -> str:
    return f"yhat_D+{h}"


def long_pairs(scored: DataFrame, keep: list[str], n: int = 14) -> DataFrame:
    """Wide targets and predictions as (keep…, horizon, y, yhat), one row per cell."""
    zipped = F.arrays_zip(
        F.array(*[F.col(quoted(target_name(h))).cast("double") for h in range(1, n + 1)]).alias("y"),
        F.array(*[F.col(quoted(prediction_name(h))) for h in range(1, n + 1)]).alias("yhat"))
    return scored.select(*keep, F.posexplode(zipped).alias("h", "c")).select(
        *keep, (F.col("h") + 1).alias("horizon"), F.col("c.y").alias("y"), F.col("c.yhat").alias("yhat"))


def error_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, unscored, mae, mape, mape_nonzero, rmse (pooled) and rmse_per_output per ``by`` group.

    ``mape`` is a fraction and lets zero actuals blow it up; ``mape_nonzero`` leaves them out.
    ``rmse_per_output`` averages the roots of the single horizons. ``n`` counts the cells with a
    value and a prediction; ``unscored`` counts those with a value alone, such as those of series
    without a model. A group without any scored cell has null errors. Two levels of sums: the
    first combines map side, the second only sees one row per group and horizon.
    """
    scored = F.col("y").isNotNull() & F.col("yhat").isNotNull()
    err = F.when(scored, F.abs(F.col("y") - F.col("yhat")))
    nonzero = scored & (F.col("y") != 0)
    per_horizon = pairs.where(F.col("y").isNotNull()).groupBy(*by, "horizon").agg(
        F.count_if(scored).alias("n"),
        F.count_if(~scored).alias("unscored"),
        F.sum(err).alias("abs_sum"),
        F.sum(err / F.greatest(F.abs("y"), F.lit(EPS))).alias("pct_sum"),
        F.sum(F.when(nonzero, err / F.abs("y"))).alias("pct_nonzero_sum"),
        F.count_if(nonzero).alias("n_nonzero"),
        F.sum(err * err).alias("sq_sum"),
    )
    n = F.sum("n")
    return per_horizon.groupBy(*by).agg(
        n.alias("n"),
        F.sum("unscored").alias("unscored"),
        F.try_divide(F.sum("abs_sum"), n).alias("mae"),
        F.try_divide(F.sum("pct_sum"), n).alias("mape"),
        F.try_divide(F.sum("pct_nonzero_sum"), F.sum("n_nonzero")).alias("mape_nonzero"),
        F.sqrt(F.try_divide(F.sum("sq_sum"), n)).alias("rmse"),
        F.avg(F.sqrt(F.try_divide(F.col("sq_sum"), F.col("n")))).alias("rmse_per_output"),
    )


def best_model(metrics: DataFrame, metric: str = "rmse", by: tuple[str, ...] = ()) -> DataFrame:
    """The model with the least error; equal errors go to the smaller name, models without an error are out."""
    return metrics.where(F.col(metric).isNotNull() & ~F.isnan(metric)).groupBy(*by).agg(
        F.min_by("model", F.struct(F.col(metric), F.col("model"))).alias("model"),
        F.min(metric).alias(metric),
    )


def forecast_vs_actual(forecast: DataFrame, actual: DataFrame, keys) -> DataFrame:
    """Forecast rows (keys, date, horizon, yhat) with the quantity of the same series and day."""
    actual = actual.select(*keys, DATE, F.col(QTY).cast("double").alias("y"))
    return forecast.join(actual, [*keys, DATE], "inner")


def naive_pairs(rows: DataFrame, keep: list[str], lags: tuple[int, ...] = (1, 7), n: int = 14,
                history: int = 14) -> DataFrame:
    """(model, keep…, horizon, y, yhat) of forecasts that repeat the last ``lag`` days, one model per lag.

    All models come out of one pass over the rows.
    """
    y = F.array(*[F.col(quoted(target_name(h))).cast("double") for h in range(1, n + 1)])
    recent = F.array(*[F.col(quoted(f"{QTY}_D-{i}")).cast("double") for i in range(1, history + 1)])
    cells = rows.select(*keep, recent.alias("recent"), F.posexplode(y).alias("h", "y")).withColumn(
        "lag", F.explode(F.array(*[F.lit(lag) for lag in lags])))
    return cells.select(
        F.concat(F.lit("naive_lag"), F.col("lag").cast("string")).alias("model"), *keep,
        (F.col("h") + 1).alias("horizon"), "y", F.col("recent")[F.col("lag") - 1 - F.col("h") % F.col("lag")].alias("yhat"))
