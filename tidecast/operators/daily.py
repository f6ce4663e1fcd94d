"""From order items to daily demand per distribution center: the only pass over the facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.config import CENTER, DATE, QTY, ForecastConfig
from tidecast.functions.calendar import utc_date


def attach_centers(products: DataFrame, centers: DataFrame) -> DataFrame:
    """Products with the attributes of their center (left: products without one stay)."""
    return products.join(centers, CENTER, "left")


def attach_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with the attributes of their product (left: unknown products stay, without a center)."""
    return items.join(products, "product_id", "left")


def _day_start(df: DataFrame, name: str, day: dt.date):
    """(column, literal) comparable without touching the column, so file scans can use the filter."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.col(name), F.lit(day).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        midnight = dt.datetime.combine(day, dt.time(), dt.timezone.utc)
        return F.col(name), F.timestamp_seconds(F.lit(int(midnight.timestamp())))
    return utc_date(df, name), F.lit(day)


def before(df: DataFrame, name: str, day: dt.date | None) -> DataFrame:
    """Rows whose UTC day lies before ``day``; None keeps all."""
    if day is None:
        return df
    col, limit = _day_start(df, name, day)
    return df.where(col < limit)


def since(df: DataFrame, name: str, day: dt.date | None) -> DataFrame:
    """Rows whose UTC day is ``day`` or later; None keeps all."""
    if day is None:
        return df
    col, limit = _day_start(df, name, day)
    return df.where(col >= limit)


def keep_centers(df: DataFrame, ids) -> DataFrame:
    ids = tuple(ids)
    if not ids:
        return df
    return df.where(F.col(CENTER) == ids[0]) if len(ids) == 1 else df.where(F.col(CENTER).isin(*ids))


def sales(items: DataFrame, keys: tuple[str, ...], price: str = "sale_price") -> DataFrame:
    """(keys, units, revenue): the facts reduced to one row per key before anything is joined to them.

    Rows with a null key are left out. Units and revenue add up, so attributes of the keys can be joined to
    this table and its rows summed by them; the facts themselves never meet a dimension.
    """
    for k in keys:
        items = items.where(F.col(k).isNotNull())
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), F.sum(price).alias("revenue"))


def sales_by(sold: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """``sales`` summed by attributes that have been joined to it; rows with a null attribute are left out."""
    return sold.dropna(subset=list(attributes)).groupBy(*attributes).agg(
        F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))


def without_statuses(items: DataFrame, statuses) -> DataFrame:
    """Drops items in the given states; items of unknown state stay."""
    statuses = tuple(statuses)
    if not statuses:
        return items
    return items.where(F.col("status").isNull() | ~F.col("status").isin(*statuses))


def units(items: DataFrame, keys: tuple[str, ...] = (CENTER,), cfg: ForecastConfig | None = None,
          created_at: str = "created_at") -> DataFrame:
    """(keys, date, qty = 1) per item; items with a null key or day are dropped.

    Every filter sits below whatever aggregates the units, where the scans can use it.
    """
    if cfg:
        items = without_statuses(keep_centers(items, cfg.centers), cfg.exclude_statuses)
        items = before(items, created_at, cfg.cutoff)
    for k in keys:
        items = items.where(F.col(k).isNotNull())
    return items.select(*keys, utc_date(items, created_at).alias(DATE), F.lit(1).alias(QTY)).where(
        F.col(DATE).isNotNull())


def daily_demand(items: DataFrame, keys: tuple[str, ...] = (CENTER,), cfg: ForecastConfig | None = None,
                 created_at: str = "created_at") -> DataFrame:
    """Units per (keys, date). One item is one unit.

    The count combines map side, so a key that holds a third of the facts moves as one row per
    task and day.
    """
    return units(items, keys, cfg, created_at).groupBy(*keys, DATE).agg(F.count(F.lit(1)).alias(QTY))


def with_attributes(demand: DataFrame, dimension: DataFrame, key: str = CENTER) -> DataFrame:
    """Attributes joined after the count, so the fact shuffle carries ids only.

    A center with a null attribute drops out, as it would from a grouping by those attributes.
    """
    return demand.join(dimension.dropna(), key, "inner")


def demand_by_region(demand: DataFrame, centers: DataFrame) -> DataFrame:
    """Daily demand rolled up from centers to regions."""
    return (
        demand.join(centers.select(CENTER, "region_id", "region_name"), CENTER, "inner")
        .groupBy("region_id", "region_name", DATE)
        .agg(F.sum(QTY).alias(QTY))
    )
