"""Calendar gap fill: every series gets one row for every day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import DATE, QTY
from tidecast.operators.splits import SPLIT


def date_bounds(df: DataFrame, date: str = DATE, by: tuple[str, ...] = ()) -> DataFrame:
    """First and last day, over all rows or per ``by``; one pass, combined map side."""
    return df.groupBy(*by).agg(F.min(date).alias("first_day"), F.max(date).alias("last_day"))


def densify(demand: DataFrame, keys: tuple[str, ...], date: str = DATE, value: str = QTY,
            bounds_by: tuple[str, ...] = (), own_range: bool = False) -> DataFrame:
    """(keys, date, value) with zero on days without demand.

    The range is that of the whole table, of each ``bounds_by`` group (a subset of ``keys``), or with
    ``own_range`` that of each series, from its own first to its own last day: the choice for
    fine grains, where one odd date would otherwise lengthen every series.
    No grid is joined: each row spawns the days up to the next row of its series, the first row
    also those before it. That takes one shuffle by series, holds at any number of series, and
    the windows built on top reuse its partitioning. A series has at most one row per day here,
    so no window partition outgrows the calendar.

    ``demand`` is read twice (rows and range): pass a staged or otherwise cheap frame.
    """
    rows = demand.select(*keys, date, value)
    if own_range:
        rows = rows.withColumns({"first_day": F.col(date), "last_day": F.col(date)})
    elif bounds_by:
        bounds = date_bounds(rows, date, bounds_by)
        if set(bounds_by) == {SPLIT}:
            # Three rows. Joined by shuffle instead, all rows would meet under three keys.
            bounds = F.broadcast(bounds)
        rows = rows.join(bounds, list(bounds_by))
    else:
        bounds = date_bounds(demand, date)
        rows = rows.withColumns({
            "first_day": bounds.select("first_day").scalar(),
            "last_day": bounds.select("last_day").scalar(),
        })
    w = Window.partitionBy(*keys).orderBy(date)
    runs = rows.select(
        *keys, date, value,
        F.when(F.lag(date).over(w).isNull(), F.col("first_day")).otherwise(F.col(date)).alias("run_from"),
        F.coalesce(F.date_sub(F.lead(date).over(w), 1), F.col("last_day")).alias("run_to"),
    )
    filled = runs.select(*keys, date, value, F.explode(F.sequence("run_from", "run_to")).alias("run_day"))
    return filled.select(
        *keys,
        F.col("run_day").alias(date),
        F.when(F.col("run_day") == F.col(date), F.col(value)).otherwise(F.lit(0)).cast("bigint").alias(value),
    )


def align_to_calendar(demand: DataFrame, days: DataFrame, date: str = DATE, value: str = QTY) -> DataFrame:
    """A single series joined onto a given calendar; the same result as ``densify`` for one series
    whose range is the calendar's."""
    return days.join(demand, date, "left").fillna(0, [value])


def backfill(df: DataFrame, keys: tuple[str, ...], columns: list[str], date: str = DATE) -> DataFrame:
    """Nulls take the next known value of their own series.

    Runs over descending dates with a growing frame, which is linear in the series length.
    """
    w = (Window.partitionBy(*keys).orderBy(F.col(date).desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
