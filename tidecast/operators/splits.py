"""Train / validation / test by date, and ordered holdouts by row count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import DATE, ForecastConfig

SPLIT = "split"


def split_label(date: Column, cfg: ForecastConfig) -> Column:
    return (
        F.when(date < F.lit(cfg.valid_from), "train")
        .when(date < F.lit(cfg.test_from), "valid")
        .otherwise("test")
    )


def with_split(df: DataFrame, cfg: ForecastConfig, date: str = DATE) -> DataFrame:
    """Adds ``split`` after dropping days at or past the cutoff."""
    if cfg.cutoff is not None:
        df = df.where(F.col(date) < F.lit(cfg.cutoff))
    return df.withColumn(SPLIT, split_label(F.col(date), cfg))


def targets_inside_split(date: Column, cfg: ForecastConfig) -> Column:
    """True where the last target day of a row still belongs to the row's own split."""
    last = F.date_add(date, cfg.horizons - 1)
    return split_label(date, cfg) == split_label(last, cfg)


def ordered_holdout(df: DataFrame, keys: tuple[str, ...], test_size: int | float, order: str = DATE) -> DataFrame:
    """Adds ``part``: the last rows of each series are 'test', the others 'train'; nothing is shuffled.

    An int is a number of rows, a fraction takes the ceiling of its share. Each series is at most
    one row per day, so ranking it in one window partition is bounded by the calendar.
    """
    w = Window.partitionBy(*keys)
    from_end = F.row_number().over(w.orderBy(F.col(order).desc()))
    if isinstance(test_size, float):
        if not 0.0 < test_size < 1.0:
            raise ValueError("a fraction must lie between 0 and 1")
        size = F.ceil(F.count(F.lit(1)).over(w) * F.lit(test_size))
    else:
        if test_size < 1:
            raise ValueError("test_size must be positive")
        size = F.lit(test_size)
    return df.withColumn("part", F.when(from_end <= size, "test").otherwise("train"))
