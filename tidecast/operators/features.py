"""Lags, steps, targets, calendar features and encodings on a dense daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import (
    DATE, QTY, STEP, ForecastConfig, lag_name, quoted, step_lag_name, target_name,
)
from tidecast.functions.calendar import (
    calendar_columns, cyclic_columns, holiday_columns, month_day, year_week,
)
from tidecast.operators.densify import date_bounds, densify
from tidecast.operators.splits import SPLIT, split_label, targets_inside_split


def _by_series(keys) -> Window:
    return Window.partitionBy(*keys).orderBy(DATE)


def with_day_step(df: DataFrame, keys, first: int = 1) -> DataFrame:
    """Running day number of each series, from ``first``."""
    return df.withColumn(STEP, (F.row_number().over(_by_series(keys)) + (first - 1)).cast("bigint"))


def with_qty_lags(df: DataFrame, keys, n: int = 14) -> DataFrame:
    w = _by_series(keys)
    return df.withColumns({lag_name(i): F.lag(QTY, i).over(w) for i in range(1, n + 1)})


def with_step_lags(df: DataFrame, n: int = 14, first: int = 1) -> DataFrame:
    """Lags of ``day_step``: the step is a row count, so lag i is step − i once i rows precede."""
    return df.withColumns({
        step_lag_name(i): F.when(F.col(STEP) - first >= i, F.col(STEP) - i) for i in range(1, n + 1)
    })


def with_targets(df: DataFrame, keys, n: int = 14) -> DataFrame:
    """y_D+1 … y_D+n, where y_D+1 is the row's own day."""
    w = _by_series(keys)
    return df.withColumns({target_name(h): F.lead(QTY, h - 1).over(w) for h in range(1, n + 1)})


def with_calendar(df: DataFrame, cfg: ForecastConfig | None = None, text_keys: bool = False) -> DataFrame:
    cfg = cfg or ForecastConfig()
    date = F.col(DATE)
    columns = {**calendar_columns(date), **holiday_columns(date, cfg.state_holidays)}
    if text_keys:
        columns |= {"year_week": year_week(date), "month_day": month_day(date)}
    return df.withColumns(columns)


def complete_rows(df: DataFrame, cfg: ForecastConfig, targets: bool = False) -> DataFrame:
    """Rows with a full set of lags and, if asked, a full set of targets."""
    df = df.where(F.col(quoted(lag_name(cfg.lags))).isNotNull())
    return df.where(F.col(quoted(target_name(cfg.horizons))).isNotNull()) if targets else df


def year_frequency(df: DataFrame, fit_on: str | None = "train") -> DataFrame:
    """Rows per year: (year, year_freq) learned on one split, or (split, year, year_freq) with None."""
    if fit_on is None:
        return df.groupBy(SPLIT, F.year(DATE).alias("year")).agg(F.count(F.lit(1)).alias("year_freq"))
    return (df.where(F.col(SPLIT) == fit_on).groupBy(F.year(DATE).alias("year"))
            .agg(F.count(F.lit(1)).alias("year_freq")))


def dense_year_frequency(demand: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """``year_frequency`` of the rows ``base_features`` makes of ``demand``, without making them.

    Every series has a row for each day of the range but its first ``cfg.lags``, so a year counts
    its days times the number of series: one distinct over the sparse table.
    """
    if cfg.cutoff is not None:
        demand = demand.where(F.col(DATE) < F.lit(cfg.cutoff))
    demand = demand.withColumn(SPLIT, split_label(F.col(DATE), cfg))
    by = [SPLIT] if cfg.per_split else []
    # Distinct first, then a count: a hot series collapses map side.
    n_series = demand.select(*by, *cfg.series).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_series"))
    bounds = date_bounds(demand, DATE, tuple(by))
    if by:
        ranges = bounds.join(n_series, by)
    else:
        ranges = bounds.withColumn("n_series", n_series.scalar())
    first = F.date_add("first_day", cfg.lags)
    days = ranges.where(first <= F.col("last_day")).select(
        "n_series", F.explode(F.sequence(first, F.col("last_day"))).alias(DATE))
    days = days.withColumn(SPLIT, split_label(F.col(DATE), cfg))
    count = F.sum("n_series").alias("year_freq")
    if cfg.year_freq_fit_on == "split":
        return days.groupBy(SPLIT, F.year(DATE).alias("year")).agg(count)
    return days.where(F.col(SPLIT) == "train").groupBy(F.year(DATE).alias("year")).agg(count)


def encode_year(df: DataFrame, frequency: DataFrame) -> DataFrame:
    """Joins the frequencies; a year never seen gets 0. The table has one row per calendar year (and
    split), a bound set by the calendar, which makes the broadcast safe."""
    on = [c for c in (SPLIT, "year") if c in frequency.columns]
    return df.join(F.broadcast(frequency), on, "left").fillna(0, ["year_freq"])


def known_days(demand: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Demand before the cutoff, all of it without one."""
    return demand if cfg.cutoff is None else demand.where(F.col(DATE) < F.lit(cfg.cutoff))


def base_features(demand: DataFrame, cfg: ForecastConfig, step_first: int = 1, step_lags: bool = True,
                  targets: bool = False, within_split: bool = True) -> DataFrame:
    """Dense days, step, lags and targets of every series, incomplete rows dropped.

    By default the history is one run and only then labelled by split: lags look back only, so
    nothing leaks, and a target that would reach into the next split drops its row (unless
    ``within_split`` is off). With ``cfg.per_split`` each split is filled and lagged on its own.
    """
    keys = cfg.series
    demand = known_days(demand, cfg)
    if cfg.per_split:
        demand = demand.withColumn(SPLIT, split_label(F.col(DATE), cfg))
        keys = (*keys, SPLIT)
    dense = densify(demand, keys, bounds_by=(SPLIT,) if cfg.per_split else ())
    frame = with_qty_lags(with_day_step(dense, keys, step_first), keys, cfg.lags)
    if targets:
        frame = with_targets(frame, keys, cfg.horizons)
    if step_lags:
        frame = with_step_lags(frame, cfg.lags, step_first)
    frame = complete_rows(frame, cfg, targets)
    if not cfg.per_split:
        frame = frame.withColumn(SPLIT, split_label(F.col(DATE), cfg))
        if targets and within_split:
            frame = frame.where(targets_inside_split(F.col(DATE), cfg))
    return frame


def template_features(demand: DataFrame, cfg: ForecastConfig, targets: bool = False) -> DataFrame:
    """Full feature table: zero-based step, lags of quantity and step, calendar, holidays, year_freq."""
    frame = with_calendar(base_features(demand, cfg, step_first=0, targets=targets), cfg)
    return encode_year(frame, dense_year_frequency(demand, cfg))


def multi_center_features(demand: DataFrame, cfg: ForecastConfig, targets: bool = False) -> DataFrame:
    """Lean feature table: one-based step, quantity lags, calendar and holiday flags."""
    frame = base_features(demand, cfg, step_first=1, step_lags=False, targets=targets)
    return with_calendar(frame, cfg).drop("is_holiday")


def transformed(frame: DataFrame, cfg: ForecastConfig) -> DataFrame:
    """Year replaced by its frequency, cyclic encodings added."""
    fit_on = None if cfg.year_freq_fit_on == "split" else "train"
    encoded = encode_year(frame, year_frequency(frame, fit_on))
    return encoded.withColumn("year", F.col("year_freq")).drop("year_freq").withColumns(cyclic_columns())


def log_target(df: DataFrame, value: str = QTY) -> DataFrame:
    return df.withColumn(f"{value}_log1p", F.log1p(F.col(value).cast("double")))


def scaled_target(df: DataFrame, value: str = QTY) -> DataFrame:
    """(x − mean) / population deviation over the whole table; a constant column scales by 1.

    The moments come from a distributed aggregate, not from a window over all rows.
    """
    stats = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    mean, sd = stats.select("m").scalar(), stats.select("s").scalar()
    return df.withColumns({"__m": mean, "__s": sd}).withColumn(
        f"{value}_scaled", (F.col(value) - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    ).drop("__m", "__s")


def last_row(df: DataFrame, keys) -> DataFrame:
    """The latest row of each series; an aggregate, so it combines map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(quoted(c)) for c in rest]), DATE).alias("r")
    ).select(*keys, *[F.col(f"r.{quoted(c)}") for c in rest])


def next_day(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.date_add(F.max(DATE), 1).alias("next_date"))


def ends_of_series(df: DataFrame, keys, n: int = 14) -> DataFrame:
    """First and last ``n`` rows of each series, marked by ``end``."""
    head = F.row_number().over(_by_series(keys))
    tail = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(DATE).desc()))
    ranked = df.withColumns({"head_pos": head, "tail_pos": tail})
    picks = F.filter(F.array(
        F.when(F.col("head_pos") <= n, F.lit("first")), F.when(F.col("tail_pos") <= n, F.lit("last"))
    ), lambda e: e.isNotNull())
    return ranked.where((F.col("head_pos") <= n) | (F.col("tail_pos") <= n)).withColumn(
        "end", F.explode(picks)).drop("head_pos", "tail_pos")


def recent_quantities(demand: DataFrame, keys, n: int = 14) -> DataFrame:
    """(keys, date, n_days, recent): the last day of the table, the length of its range, and the
    quantities of the last ``n`` days of each series, newest first, silent days as zero.

    A conditional sum per day: no gap fill, no window, one shuffle that combines map side. In a
    range shorter than ``n`` days the days before it count as silent. Takes sparse or dense demand.
    """
    bounds = date_bounds(demand, DATE)
    rows = demand.withColumns({
        "__first": bounds.select("first_day").scalar(), "__last": bounds.select("last_day").scalar()})
    age = F.datediff("__last", DATE)
    sums = rows.groupBy(*keys).agg(
        F.max("__last").alias(DATE), (F.datediff(F.max("__last"), F.max("__first")) + 1).alias("n_days"),
        *[F.sum(F.when(age == i, F.col(QTY)).otherwise(0)).alias(f"__{i}") for i in range(n)])
    return sums.select(
        *keys, DATE, "n_days", F.array(*[f"__{i}" for i in range(n)]).alias("recent"))


def future_rows(demand: DataFrame, cfg: ForecastConfig, step_first: int = 1) -> DataFrame:
    """One row per series for the day after the end: its lags are the last known quantities.

    The end is that of the days before ``cfg.cutoff``, as in training.
    """
    last = recent_quantities(known_days(demand, cfg), cfg.series, cfg.lags)
    return last.select(
        *cfg.series, F.date_add(DATE, 1).alias(DATE), (F.col("n_days") + step_first).cast("bigint").alias(STEP),
        *[F.col("recent")[i - 1].alias(lag_name(i)) for i in range(1, cfg.lags + 1)])
