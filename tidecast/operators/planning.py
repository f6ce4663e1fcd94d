"""From forecasts and recent demand to product demand, safety stock and order quantities."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import CENTER, DATE, QTY, ForecastConfig, lag_names, target_names
from tidecast.operators.daily import before, since
from tidecast.operators.densify import date_bounds
from tidecast.operators.features import base_features, future_rows
from tidecast.operators.linear import fit_linear, score_long

# Fixed values of the purchasing policy, in days.
LEAD_TIME = 7
SAFETY_DAYS = 7
PLAN_DAYS = 60
AVERAGE_DAYS = 90
MIX_MONTHS = 3
# Centers whose totals may be broadcast to their products.
MOST_CENTERS = 100_000


def history_of(demand: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last day with demand, None without any: two values, read to prune the scans that depend on them."""
    return tuple(date_bounds(demand).first())


def two_week_demand(demand: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Units each series is expected to sell in the days after its history ends.

    The model trains on all rows whose targets are known, then scores the day after the last.
    """
    rows = base_features(demand, cfg, step_lags=False, targets=True, within_split=False)
    x = lag_names(cfg.lags)
    model = fit_linear(rows, cfg.series, x, target_names(cfg.horizons))
    cells = score_long(future_rows(demand, cfg), model, cfg.series, [*cfg.series, DATE], x, y=[])
    return cells.groupBy(*cfg.series, F.col(DATE).alias("first_day")).agg(F.sum("yhat").alias("units"))


def product_mix(items: DataFrame, demand: DataFrame, as_of: dt.date | None, product: str = "product_id",
                months: int = MIX_MONTHS, created_at: str = "created_at") -> DataFrame:
    """(center, product, units, mix): share of a center's units over (as_of − months, as_of].

    Totals per center come from the daily table, so the facts are read once, for these months
    only, and no window gathers all products of a center. Without a day (no history) there are no rows.
    """
    if as_of is None:
        items, as_of = items.where(F.lit(False)), dt.date(1970, 1, 1)
    totals = demand.where((F.col(DATE) > F.lit(_months_back(as_of, months))) & (F.col(DATE) <= F.lit(as_of))).groupBy(CENTER).agg(
        F.sum(QTY).alias("center_units"))
    if totals.count() <= MOST_CENTERS:  # else all products of a center would meet under its key
        totals = F.broadcast(totals)
    units = recent_items(items, as_of, months, created_at).where(
        F.col(CENTER).isNotNull() & F.col(product).isNotNull()).groupBy(CENTER, product).agg(
        F.count(F.lit(1)).alias("units"))
    return units.join(totals, CENTER).select(
        CENTER, product, "units", (F.col("units") / F.col("center_units")).alias("mix"))


def mix_of_days(grain: DataFrame, demand: DataFrame, as_of: dt.date | None, product: str = "product_id",
                months: int = MIX_MONTHS) -> DataFrame:
    """``product_mix`` from daily demand by center and product, where that table is at hand."""
    if as_of is None:
        grain, demand, as_of = grain.where(F.lit(False)), demand.where(F.lit(False)), dt.date(1970, 1, 1)
    recent = (F.col(DATE) > F.lit(_months_back(as_of, months))) & (F.col(DATE) <= F.lit(as_of))
    totals = demand.where(recent).groupBy(CENTER).agg(F.sum(QTY).alias("center_units"))
    if totals.count() <= MOST_CENTERS:
        totals = F.broadcast(totals)
    units = grain.where(recent).groupBy(CENTER, product).agg(F.sum(QTY).alias("units"))
    return units.join(totals, CENTER).select(CENTER, product, "units", (F.col("units") / F.col("center_units")).alias("mix"))


def recent_items(items: DataFrame, as_of: dt.date, months: int, created_at: str = "created_at") -> DataFrame:
    """Items of the last months, cut by literal bounds the scan can use."""
    first = _months_back(as_of, months) + dt.timedelta(days=1)
    return before(since(items, created_at, first), created_at, as_of + dt.timedelta(days=1))


def _months_back(day: dt.date, months: int) -> dt.date:
    """Same day of an earlier month, clipped to that month's end."""
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    following = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    return dt.date(year, month + 1, min(day.day, (following - dt.timedelta(days=1)).day))


def product_demand(mix: DataFrame, center_units: DataFrame, product: str = "product_id") -> DataFrame:
    """Expected units of each product: its mix times the units expected at its center."""
    expected = center_units.select(CENTER, F.col("units").alias("expected"))
    if expected.count() <= MOST_CENTERS:  # else the products of a center would meet under its key
        expected = F.broadcast(expected)
    return mix.join(expected, CENTER).select(
        CENTER, product, "units", "mix", (F.col("mix") * F.col("expected")).alias("expected_units"))


def recent_average(demand: DataFrame, keys, days: int = AVERAGE_DAYS,
                   history: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """(keys, avg_qty): mean over the last ``days`` calendar days, silent days counting as zero.

    Dividing by the number of days replaces the gap fill; a history shorter than the window
    divides by its own length. Series without recent demand stay, with 0. ``demand`` may hold
    several rows a day, such as ``daily.units``: with ``history`` (first and last day) given it
    is read once and reduced by one shuffle, whatever the grain of ``keys``.
    """
    if history and None not in history:
        first, last = F.lit(history[0]), F.lit(history[1])
    else:
        bounds = date_bounds(demand)
        first, last = bounds.select("first_day").scalar(), bounds.select("last_day").scalar()
    rows = demand.withColumns({"__first": first, "__last": last})
    recent = (F.col(DATE) > F.date_sub(F.col("__last"), days)) & (F.col(DATE) <= F.col("__last"))
    span = F.least(F.lit(days), F.datediff(F.max("__last"), F.max("__first")) + 1)
    return rows.groupBy(*keys).agg(
        (F.sum(F.when(recent, F.col(QTY)).otherwise(0)) / span).alias("avg_qty"))


def safety_stock(demand: DataFrame, keys, history=None) -> DataFrame:
    """One week of average demand."""
    return recent_average(demand, keys, history=history).withColumn("safety_stock", F.col("avg_qty") * SAFETY_DAYS)


def order_quantity(demand: DataFrame, keys, history=None) -> DataFrame:
    """Gross units to order for two months and the lead time, on top of the safety stock."""
    need = F.col("avg_qty") * (PLAN_DAYS + LEAD_TIME) + F.col("safety_stock")
    # Rounding first keeps a whole number from being lifted by a stray last bit.
    return safety_stock(demand, keys, history).withColumn("order_qty", F.ceil(F.round(need, 6)))
