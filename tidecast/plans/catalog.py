"""Named queries over a folder of star-schema tables; each takes (spark, folder).

Column names avoid '-' and '+', and doubles are rounded, so that results can be compared with
other SQL engines (see ``oracle``).
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.config import (
    CENTER, CENTER_NAME, DATE, QTY, SHALLOW_BOOST, STEP, BoostParams, ForecastConfig, lag_name, lag_names, quoted, target_names,
)
from tidecast.functions import calendar as cal
from tidecast.operators import (
    daily, densify as dense_ops, features as feat, linear, maintained, metrics as met, planning, profile, sketches, splits, trees,
)
from tidecast.plans import jobs
from tidecast.sources import loader, sinks, sql_functions, tables
from tidecast.sources.loader import prefixed
from tidecast.sources.sinks import preview_view
from tidecast.staging import shared_folder, stage

# The whole history, and the same with the odd last day cut off and split by date.
ALL = ForecastConfig(cutoff=None, valid_from=dt.date(2001, 4, 1), test_from=dt.date(2001, 7, 1))
CUT = replace(ALL, cutoff=dt.date(2001, 8, 1))
# One lag and one day ahead, where least squares have a closed form.
ONE = replace(CUT, lags=1, horizons=1)
# One tree without and with a single split, which predict means.
STUMP = BoostParams(n_estimators=1, eta=1.0, max_depth=0, subsample=1.0, colsample=1.0)
SPLIT_ONCE = replace(STUMP, max_depth=1)
# Sizes of models in queries where the full ones take minutes (README): levels of forests, trees per horizon and
# of the importance forest.
FOREST_DEPTH, PER_HORIZON_TREES, IMPORTANCE_TREES = 5, 10, 100
KEYS = (CENTER,)

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def demand(spark, folder, cfg=ALL) -> DataFrame:
    """Daily demand per center, reduced from the facts once and staged for all plans on top."""
    return stage(daily.daily_demand(tables.order_items(spark, folder), KEYS, cfg), "demand")


def dense(spark, folder, cfg=ALL) -> DataFrame:
    return dense_ops.densify(demand(spark, folder, cfg), KEYS)


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(quoted(c)), digits) for c in names})


def plain(df: DataFrame) -> DataFrame:
    return trees.plain_names(df)


# --- daily demand -----------------------------------------------------------------------------

@query
def daily_demand(spark: SparkSession, folder: str) -> DataFrame:
    counted = daily.daily_demand(tables.order_items(spark, folder), KEYS, ALL)
    return daily.with_attributes(counted, tables.centers(spark, folder).select(CENTER, CENTER_NAME))


@query
def demand_from_csv(spark, folder):
    """Daily demand of items that were written as CSV, with quotes and commas in a cell, and read back."""
    items = tables.order_items(spark, folder, "order_id", "product_id", "status", "created_at", CENTER)
    day = F.concat(cal.utc_date(items, "created_at").cast("string"), F.lit(" 00:00:00 UTC"))
    text = items.withColumns({"created_at": day, "note": F.concat(F.lit('a "'), "status", F.lit('", \\ and more'))})
    path = f"{shared_folder(spark)}/items-{uuid.uuid4().hex}"
    sinks.save_table(text.select("order_id", "note", "product_id", "status", "created_at", CENTER), path, fmt="csv")
    again = loader.read_csv(spark, path, {**loader.ORDER_ITEM_TYPES, CENTER: "bigint"})
    counted = daily.daily_demand(again.where(F.col("note") == F.concat(F.lit('a "'), "status", F.lit('", \\ and more'))), KEYS, ALL)
    return daily.with_attributes(counted, tables.centers(spark, folder).select(CENTER, CENTER_NAME))


@query
def demand_by_category(spark, folder):
    """Units and revenue by category of the product and name of the center: facts joined to both dimensions."""
    sold = daily.sales(tables.order_items(spark, folder, "product_id", "sale_price", CENTER), ("product_id", CENTER))
    parts = tables.products(spark, folder).select(F.col("id").alias("product_id"), "category")
    named = daily.attach_centers(daily.attach_products(sold, parts), tables.centers(spark, folder).select(CENTER, CENTER_NAME))
    return daily.sales_by(named, ("category", CENTER_NAME)).withColumn("revenue", F.round("revenue", 2))


@query
def daily_demand_maintained(spark, folder):
    """Demand kept as counts per load: half of the days, then the others, then the first half again, which replaces itself."""
    items = tables.order_items(spark, folder, "created_at", CENTER)
    path = f"{shared_folder(spark)}/maintained-{uuid.uuid4().hex}"
    first, second = daily.before(items, "created_at", dt.date(1998, 1, 1)), daily.since(items, "created_at", dt.date(1998, 1, 1))
    for load, rows in (("old", first), ("new", second), ("old", first)):
        maintained.ingest(rows, path, load, KEYS, ALL)
    return daily.with_attributes(maintained.maintained_demand(spark, path), tables.centers(spark, folder).select(CENTER, CENTER_NAME))


@query
def demand_of_replaced_splits(spark, folder):
    """Daily demand saved by split; one split is then written anew, which leaves the others."""
    rows = splits.with_split(demand(spark, folder, CUT), CUT)
    path = f"{shared_folder(spark)}/splits-{uuid.uuid4().hex}"
    sinks.save_splits(rows.withColumn(QTY, F.when(F.col(splits.SPLIT) == "valid", -F.col(QTY)).otherwise(F.col(QTY))), path)
    sinks.replace_splits(rows.where(F.col(splits.SPLIT) == "valid"), path)
    read = [sinks.load_split(spark, path, part) for part in ("train", "valid", "test")]
    return read[0].unionByName(read[1]).unionByName(read[2]).select(*rows.columns)


@query
def series_from_csv(spark, folder):
    """Daily demand written as CSV by the engine and read back with its day as an ordinary column."""
    path = f"{shared_folder(spark)}/series-{uuid.uuid4().hex}"
    sinks.save_table(demand(spark, folder), path, fmt="csv")
    return loader.read_series(spark, path, DATE, {CENTER: "bigint", QTY: "bigint"})


@query
def daily_demand_one_dc(spark, folder):
    return daily.daily_demand(tables.order_items(spark, folder), KEYS, replace(CUT, centers=(1,)))


@query
def daily_demand_excl_status(spark, folder):
    return daily.daily_demand(tables.order_items(spark, folder), KEYS, replace(ALL, exclude_statuses=("F",)))


@query
def demand_by_region(spark, folder):
    counted = daily.daily_demand(tables.order_items(spark, folder), KEYS, ALL)
    return daily.demand_by_region(counted, tables.centers(spark, folder))


@query
def orders_in_dc_list(spark, folder):
    return daily.daily_demand(tables.order_items(spark, folder), KEYS, replace(ALL, centers=(1, 2, 3)))


@query
def demand_cutoff_split(spark, folder):
    return splits.with_split(daily.daily_demand(tables.order_items(spark, folder), KEYS, CUT), CUT)


@query
def demand_year_window(spark, folder):
    """Days strictly between two dates."""
    items = tables.order_items(spark, folder)
    items = daily.before(daily.since(items, "created_at", dt.date(2000, 1, 2)), "created_at", dt.date(2001, 1, 1))
    return daily.daily_demand(items, KEYS, ALL)


@query
def product_daily_demand(spark, folder):
    """The same count at product grain: a series per product and center."""
    return daily.daily_demand(tables.order_items(spark, folder), (CENTER, "product_id"), ALL)


@query
def ordered_holdout_count(spark, folder):
    return splits.ordered_holdout(demand(spark, folder), KEYS, 60)


@query
def ordered_holdout_fraction(spark, folder):
    return splits.ordered_holdout(demand(spark, folder), KEYS, 0.25)


# --- gap fill -----------------------------------------------------------------------------------

@query
def dense_demand_one_series(spark, folder):
    one = stage(daily.daily_demand(tables.order_items(spark, folder), KEYS, replace(ALL, centers=(1,))), "demand")
    bounds = dense_ops.date_bounds(one)
    days = bounds.select(F.explode(F.sequence("first_day", "last_day")).alias(DATE))
    return dense_ops.align_to_calendar(one.select(DATE, QTY), days)


@query
def dense_demand_per_dc(spark, folder):
    return dense(spark, folder)


@query
def dense_demand_per_split(spark, folder):
    labelled = splits.with_split(demand(spark, folder, CUT), CUT)
    return dense_ops.densify(labelled, (CENTER, splits.SPLIT), bounds_by=(splits.SPLIT,))


@query
def backfill_attributes(spark, folder):
    """Names known on days with demand only, filled backwards inside each center."""
    rows = demand(spark, folder)
    known = rows.select(CENTER, DATE, F.lit(True).alias("has_demand"))
    names = tables.centers(spark, folder).select(CENTER, CENTER_NAME)
    gappy = (dense_ops.densify(rows, KEYS).join(known, [CENTER, DATE], "left").join(names, CENTER, "left")
             .withColumn(CENTER_NAME, F.when(F.col("has_demand"), F.col(CENTER_NAME))).drop("has_demand"))
    return dense_ops.backfill(gappy, KEYS, [CENTER_NAME])


# --- windows and features -------------------------------------------------------------------------

@query
def features_qty_lags(spark, folder):
    return plain(feat.complete_rows(feat.with_qty_lags(dense(spark, folder), KEYS), ALL))


@query
def features_by_sql(spark, folder):
    """The lag features by SQL statements alone, over the registered view of demand."""
    sql_functions.register_demand(demand(spark, folder), KEYS)
    return spark.sql("SELECT * FROM demand_lagged() WHERE qty_d14 IS NOT NULL")


@query
def demand_filled_by_sql(spark, folder):
    sql_functions.register_demand(demand(spark, folder), KEYS)
    return spark.sql("SELECT * FROM demand_filled()")


@query
def features_step_lags(spark, folder):
    rows = feat.with_step_lags(feat.with_day_step(dense(spark, folder), KEYS))
    return plain(rows.where(F.col(quoted("day_step_D-14")).isNotNull()))


@query
def day_step_zero_based(spark, folder):
    return feat.with_day_step(dense(spark, folder), KEYS, first=0)


@query
def multistep_targets(spark, folder):
    rows = feat.with_targets(dense(spark, folder), KEYS)
    return plain(rows.where(F.col(quoted("y_D+14")).isNotNull()))


@query
def aligned_xy(spark, folder):
    """Rows of the cut history with all lags and all targets, targets not crossing a split."""
    return plain(feat.base_features(demand(spark, folder, CUT), CUT, step_lags=False, targets=True))


@query
def calendar_features(spark, folder):
    days = dense(spark, folder)
    return days.withColumns({**cal.calendar_columns(F.col(DATE)), "month_day": cal.month_day(F.col(DATE))})


@query
def year_week_key(spark, folder):
    rows = demand(spark, folder).withColumn("year_week", cal.year_week(F.col(DATE)))
    return rows.groupBy("year_week").agg(
        F.sum(QTY).alias(QTY), F.min(DATE).alias("first_day"), F.max(DATE).alias("last_day"))


@query
def holiday_flags(spark, folder):
    """Membership of each day of demand in the holiday dimension, by join."""
    rows = demand(spark, folder)
    # 16 rows a year at most, and no more years than the calendar has.
    days = cal.holidays_on(rows).select(DATE).distinct().withColumn("hit", F.lit(1))
    state = cal.is_state_holiday(F.col(DATE))
    national = F.coalesce(F.col("hit"), F.lit(0))
    return rows.join(F.broadcast(days), DATE, "left").select(
        CENTER, DATE, QTY, national.alias("is_national_holiday"), state.alias("is_state_holiday"),
        (national + state).alias("is_holiday"))


@query
def demand_on_holidays(spark, folder):
    """Holiday names and the demand on them, actual and observed days apart."""
    rows = demand(spark, folder)
    return rows.join(F.broadcast(cal.holidays_on(rows)), DATE).groupBy("holiday", "observed").agg(
        F.sum(QTY).alias(QTY), F.count_distinct(DATE).alias("n_days"))


@query
def cyclic_encoding(spark, folder):
    rows = demand(spark, folder).withColumns(cal.calendar_columns(F.col(DATE)))
    return rounded(rows.withColumns(cal.cyclic_columns()), 9)


@query
def year_frequency(spark, folder):
    """Train frequencies joined to every split; unseen years would read 0."""
    rows = splits.with_split(dense(spark, folder, CUT), CUT).withColumn("year", F.year(DATE))
    return feat.encode_year(rows, feat.year_frequency(rows))


@query
def log_target(spark, folder):
    return rounded(feat.log_target(demand(spark, folder)), 9)


@query
def scaled_target(spark, folder):
    return rounded(feat.scaled_target(demand(spark, folder)))


@query
def full_features_template(spark, folder):
    return plain(feat.template_features(demand(spark, folder, CUT), CUT))


@query
def full_features_per_split(spark, folder):
    cfg = replace(CUT, per_split=True, year_freq_fit_on="split")
    return plain(feat.template_features(demand(spark, folder, cfg), cfg))


@query
def full_features_multi_dc(spark, folder):
    return plain(feat.multi_center_features(demand(spark, folder, CUT), CUT))


@query
def features_transformed(spark, folder):
    rows = demand(spark, folder, CUT)
    return rounded(plain(feat.transformed(feat.multi_center_features(rows, CUT), CUT)), 9)


@query
def last_row_per_series(spark, folder):
    return plain(feat.last_row(feat.with_qty_lags(dense(spark, folder), KEYS, 3), KEYS))


@query
def next_day_per_series(spark, folder):
    return feat.next_day(demand(spark, folder), KEYS)


@query
def first_last_14(spark, folder):
    return feat.ends_of_series(dense(spark, folder), KEYS)


# --- profiles ---------------------------------------------------------------------------------------

@query
def status_counts(spark, folder):
    return profile.value_counts(tables.order_items(spark, folder, "status"), "status")


@query
def items_per_product(spark, folder):
    return profile.value_counts(tables.order_items(spark, folder, "product_id"), "product_id")


@query
def items_per_dc(spark, folder):
    return profile.value_counts(tables.order_items(spark, folder, CENTER), CENTER)


@query
def pareto_products(spark, folder):
    counts = profile.value_counts(tables.order_items(spark, folder, "product_id"), "product_id")
    return rounded(profile.pareto(counts, "product_id").drop("running_all"), 9)


@query
def pareto_concentration(spark, folder):
    counts = profile.value_counts(tables.order_items(spark, folder, "product_id"), "product_id")
    return rounded(profile.concentration(profile.pareto(counts, "product_id")), 9)


@query
def distinct_counts(spark, folder):
    return profile.distinct_counts(
        tables.order_items(spark, folder))


@query
def distinct_counts_by_sketch(spark, folder):
    """Sketches of every column by year of the order, united: whether the counts are within their bound of the exact ones."""
    items = tables.order_items(spark, folder)
    kept = stage(sketches.distinct_sketches(items.withColumn("year", F.year(cal.utc_date(items, "created_at"))), by=("year",)), "sketches")
    both = sketches.united_counts(kept).join(profile.distinct_counts(items).withColumnRenamed("n_distinct", "exact"), "column")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= F.ceil(F.col("exact") * sketches.error_bound())
    return both.select("column", F.col("exact").alias("n_exact"), near.alias("within_bound"))


@query
def quantiles_by_sketch(spark, folder):
    """Quantile sketches of all numeric columns by year of the order, united: whether ranks are within their bound of the exact ones."""
    items = tables.order_items(spark, folder)
    dated = items.withColumn("year", F.year(cal.utc_date(items, "created_at")))
    kept = stage(sketches.quantile_sketches(dated, profile.numeric_columns(items), by=("year",)), "sketches")
    united = stage(sketches.united_quantiles(kept, (0.05, 0.25, 0.5, 0.75, 0.95)), "quantiles")
    near = sketches.rank_errors(items, united).select("column", "p", (F.col("error") <= sketches.rank_error_bound()).alias("within_bound"))
    return united.select("column", "p", F.col("count").alias("n_values")).join(near, ["column", "p"])


@query
def distinct_dcs(spark, folder):
    return profile.distinct_values(tables.order_items(spark, folder, CENTER), CENTER)


@query
def null_counts(spark, folder):
    return profile.null_counts(tables.order_items(spark, folder))


@query
def null_lags(spark, folder):
    """Nulls that shifting leaves at the start of each series."""
    return profile.null_counts(plain(feat.with_qty_lags(dense(spark, folder), KEYS)))


@query
def duplicate_rows(spark, folder):
    return profile.duplicate_rows(tables.order_items(spark, folder))


@query
def describe_numeric(spark, folder):
    rows = feat.complete_rows(feat.with_qty_lags(dense(spark, folder), KEYS), ALL)
    return rounded(profile.describe_numeric(plain(feat.with_day_step(rows, KEYS))))


@query
def describe_prices(spark, folder):
    """A description straight over the facts, with a column of many distinct values."""
    return rounded(profile.describe_numeric(tables.order_items(spark, folder, "sale_price"), ["sale_price"]), 4)


@query
def describe_categorical(spark, folder):
    return profile.describe_categorical(tables.products(spark, folder), ["name", "brand", "category"])


@query
def qty_histogram(spark, folder):
    return profile.histogram(dense(spark, folder), QTY, 2.0)


@query
def column_profile(spark, folder):
    return rounded(profile.column_profile(tables.products(spark, folder)))


@query
def correlation_matrix(spark, folder):
    rows = plain(feat.complete_rows(feat.with_qty_lags(dense(spark, folder), KEYS), ALL))
    return rounded(profile.correlations(rows, profile.numeric_columns(rows)))


@query
def daily_date_bounds(spark, folder):
    return dense_ops.date_bounds(demand(spark, folder))


@query
def table_shape(spark, folder):
    return profile.shape(demand(spark, folder))


@query
def numeric_columns_profile(spark, folder):
    """Non-null count and rounded mean of the columns that are numeric by type."""
    items = tables.order_items(spark, folder, "order_id", "product_id", "sale_price", CENTER)
    columns = profile.numeric_columns(items)
    one = items.agg(*[F.count(c).alias(f"n_{c}") for c in columns], *[F.avg(c).alias(f"m_{c}") for c in columns])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.round(f"m_{c}", 2).alias("mean"))
             for c in columns]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


@query
def demand_sorted_limit(spark, folder):
    """The 20 strongest (day, center) pairs: a top-k report."""
    return profile.preview(demand(spark, folder), 20, [F.desc(QTY), F.col(DATE), F.col(CENTER)])


# --- projections --------------------------------------------------------------------------------------

@query
def prefixed_products(spark, folder):
    return prefixed(tables.products(spark, folder), "product_")


@query
def renamed_projection(spark, folder):
    items = tables.order_items(spark, folder).drop("status", "sale_price")
    return items.withColumnsRenamed({"created_at": DATE, CENTER: "dc_id"}).select(
        "order_id", "product_id", "dc_id", F.col(DATE).cast("date").alias(DATE))


@query
def constant_and_cast(spark, folder):
    rows = demand(spark, folder)
    return rows.select(
        F.col(CENTER).cast("string").alias("dc_text"), DATE, F.lit(0).alias("zero"),
        F.col(QTY).cast("double").alias("qty_float"), F.year(DATE).cast("string").alias("year_text"))


@query
def sql_preview(spark, folder):
    """A temporary view read through SQL: the first rows of a report."""
    return preview_view(tables.table(spark, folder, "part").select("p_partkey", "p_name", "p_brand"),
                        "tidecast_products", "p_partkey", 10)


@query
def fixture_sample(spark, folder):
    """The first rows of a source in key order, as a sample for tests."""
    return profile.preview(tables.products(spark, folder), 10, ["id"])


# --- metrics --------------------------------------------------------------------------------------------

def naive_pairs(spark, folder) -> DataFrame:
    return met.naive_pairs(xy(spark, folder), [splits.SPLIT])


@query
def metrics_by_model_split(spark, folder):
    return rounded(met.error_metrics(naive_pairs(spark, folder), ["model", splits.SPLIT]).drop(
        "mape", "rmse_per_output"))


@query
def rmse_variants(spark, folder):
    """Pooled and per-output RMSE, and the eps-guarded MAPE scaled to a comparable size."""
    m = met.error_metrics(naive_pairs(spark, folder), ["model", splits.SPLIT])
    return rounded(m.select("model", splits.SPLIT, "rmse", "rmse_per_output", (F.col("mape") * met.EPS).alias("mape_eps")))


@query
def best_model(spark, folder):
    m = met.error_metrics(naive_pairs(spark, folder), ["model", splits.SPLIT])
    return rounded(met.best_model(m, by=(splits.SPLIT,)))


@query
def forecast_vs_actual(spark, folder):
    """A forecast repeating the last train week, against the actual validation days, by date."""
    days = stage(dense(spark, folder, CUT), "days")
    week = days.where((F.col(DATE) < F.lit(CUT.valid_from)) & (F.col(DATE) >= F.date_sub(F.lit(CUT.valid_from), 7)))
    forecast = week.select(CENTER, F.explode(F.array(F.lit(7), F.lit(14))).alias("shift"), DATE, QTY).select(
        CENTER, F.date_add(DATE, F.col("shift")).alias(DATE), F.col(QTY).cast("double").alias("yhat")
    ).withColumn("horizon", F.datediff(DATE, F.lit(CUT.valid_from)) + 1)
    return met.forecast_vs_actual(stage(forecast, "forecast"), days, KEYS)


# --- linear model ---------------------------------------------------------------------------------------

def xy(spark, folder) -> DataFrame:
    return feat.base_features(demand(spark, folder, CUT), CUT, step_lags=False, targets=True)


@query
def lr_sufficient_stats(spark, folder):
    """All sums of products a fit needs, as (center, term, column, total)."""
    stats = linear.sufficient_statistics(xy(spark, folder).where("split = 'train'"), KEYS, lag_names(), target_names())
    return stats.select(CENTER, "term", F.posexplode("s").alias("col", "total"))


@query
def lr_one_lag(spark, folder):
    """A fit on one lag and one horizon, where other engines have closed-form aggregates."""
    model = linear.fit_linear(xy(spark, folder).where("split = 'train'"), KEYS, [lag_name(1)], ["y_D+1"])
    return rounded(model.select(CENTER, "n_rows", F.col("intercepts")[0].alias("intercept"),
                                F.col("weights")[0][0].alias("slope")))


@query
def lr_normal_equations(spark, folder):
    """What defines a least-squares fit: residuals sum to zero, alone and against every lag."""
    frame = stage(xy(spark, folder).where("split = 'train'"), "xy")
    model = stage(linear.fit_linear(frame, KEYS), "model")
    lags = lag_names()
    cells = linear.score_long(frame, model, KEYS, [CENTER, *[F.col(quoted(c)) for c in lags]])
    residual = F.col("y") - F.col("yhat")
    sums = cells.groupBy(CENTER, "horizon").agg(
        F.array(F.sum(residual), *[F.sum(residual * F.col(quoted(c))) for c in lags]).alias("s"))
    return sums.select(CENTER, "horizon", F.posexplode("s").alias("term", "gradient")).withColumn(
        "gradient", F.round("gradient", 4) + 0.0)


def fixed_model(rows: DataFrame) -> DataFrame:
    """The same stated coefficients for every center: horizon h weighs lag j by 1 / (h + j)."""
    weights = F.array(*[F.array(*[F.lit(1.0 / (h + j)) for j in range(1, 15)]) for h in range(1, 15)])
    return rows.select(CENTER).distinct().select(
        CENTER, F.array(*[F.lit(h / 10.0) for h in range(1, 15)]).alias("intercepts"), weights.alias("weights"))


@query
def lr_score_fixed_coefficients(spark, folder):
    rows = demand(spark, folder)
    frame = feat.complete_rows(feat.with_qty_lags(dense_ops.densify(rows, KEYS), KEYS), ALL)
    scored = linear.score_linear(frame, fixed_model(rows), KEYS)
    named = {met.prediction_name(h): f"yhat_d{h}" for h in range(1, 15)}
    return rounded(scored.select(CENTER, DATE, *[F.col(quoted(a)).alias(b) for a, b in named.items()]))


@query
def lr_metrics_fixed_coefficients(spark, folder):
    rows = demand(spark, folder, CUT)
    return rounded(jobs.linear_metrics(rows, fixed_model(rows), CUT).drop("mape"))


@query
def lr_fit_predict(spark, folder):
    """Fit on train, errors on every split."""
    frame = stage(xy(spark, folder), "xy")
    model = stage(linear.fit_linear(frame.where("split = 'train'"), KEYS), "model")
    return rounded(jobs.split_errors(frame, model, CUT))


@query
def lr_fit_predict_one_lag(spark, folder):
    """The same fit and errors with one lag and one day ahead."""
    frame = stage(feat.base_features(demand(spark, folder, CUT), ONE, step_lags=False, targets=True), "xy")
    model = stage(linear.fit_linear(frame.where("split = 'train'"), KEYS, *jobs.columns_of(ONE)), "model")
    return rounded(jobs.split_errors(frame, model, ONE).drop("mape"))


@query
def lr_pooled_one_lag(spark, folder):
    frame = feat.base_features(demand(spark, folder, CUT), ONE, step_lags=False, targets=True).where("split = 'train'")
    x, y = jobs.columns_of(ONE)
    return rounded(linear.coefficient_rows(linear.fit_linear(frame, (), x, y), (), x))


@query
def lr_single_step_one_lag(spark, folder):
    rows = feat.complete_rows(feat.with_qty_lags(dense(spark, folder), KEYS, 1), replace(ALL, lags=1))
    parts = stage(splits.ordered_holdout(rows, KEYS, 60), "parts")
    model = stage(linear.fit_linear(parts.where("part = 'train'"), KEYS, [lag_name(1)], [QTY]), "model")
    cells = linear.score_long(parts, model, KEYS, ["part"], [lag_name(1)], [QTY])
    return rounded(met.error_metrics(cells, ["part"]).drop("mape"))


@query
def true_vs_predicted_one_lag(spark, folder):
    frame = stage(feat.base_features(demand(spark, folder, CUT), ONE, step_lags=False, targets=True), "xy")
    x, y = jobs.columns_of(ONE)
    model = stage(linear.fit_linear(frame.where("split = 'train'"), KEYS, x, y), "model")
    return rounded(linear.score_long(frame.where("split <> 'train'"), model, KEYS, [CENTER, DATE], x, y))


@query
def batch_predict_one_lag(spark, folder):
    """Test days with their predictions beside features and targets."""
    frame = stage(feat.base_features(demand(spark, folder, CUT), ONE, step_lags=False, targets=True), "xy")
    model = stage(linear.fit_linear(frame.where("split = 'train'"), KEYS, *jobs.columns_of(ONE)), "model")
    return rounded(plain(jobs.batch_predict(frame.where("split = 'test'"), model, ONE)[0]))


@query
def next_day_demand_dc(spark, folder):
    """The planning forecast with one lag and one day ahead."""
    return rounded(planning.two_week_demand(demand(spark, folder, CUT), ONE))


@query
def product_demand_next_day(spark, folder):
    """Mix of the last three months times the forecast of the next day."""
    items, rows = tables.order_items(spark, folder), demand(spark, folder)
    mix = planning.product_mix(items, rows, planning.history_of(rows)[1])
    return rounded(planning.product_demand(mix, planning.two_week_demand(rows, replace(ONE, cutoff=None))))


@query
def lr_coefficients(spark, folder):
    frame = xy(spark, folder).where("split = 'train'")
    return rounded(linear.coefficient_rows(linear.fit_linear(frame, KEYS), KEYS))


@query
def lr_pooled(spark, folder):
    """One model over the rows of all centers."""
    return rounded(linear.coefficient_rows(linear.fit_linear(xy(spark, folder).where("split = 'train'"), ()), ()))


@query
def lr_single_step(spark, folder):
    """Same-day quantity from its lags, the last 60 days of each center held out."""
    rows = feat.complete_rows(feat.with_qty_lags(dense(spark, folder), KEYS), ALL)
    parts = stage(splits.ordered_holdout(rows, KEYS, 60), "parts")
    model = stage(linear.fit_linear(parts.where("part = 'train'"), KEYS, y=[QTY]), "model")
    cells = linear.score_long(parts, model, KEYS, ["part"], y=[QTY])
    return rounded(met.error_metrics(cells, ["part"]))


@query
def batch_predict(spark, folder):
    """Test days of the feature table with their predictions, rows without all targets left null."""
    rows = demand(spark, folder, CUT)
    train = feat.base_features(rows, CUT, step_lags=False, targets=True).where("split = 'train'")
    model = stage(linear.fit_linear(train, KEYS), "model")
    test = feat.with_targets(feat.template_features(rows, CUT).where("split = 'test'"), KEYS)
    return rounded(plain(jobs.batch_predict(test, model, CUT, only_with_targets=True)[0]))


@query
def true_vs_predicted(spark, folder):
    frame = stage(xy(spark, folder), "xy")
    model = stage(linear.fit_linear(frame.where("split = 'train'"), KEYS), "model")
    return rounded(linear.score_long(frame.where("split <> 'train'"), model, KEYS, [CENTER, DATE]))


# --- trees ------------------------------------------------------------------------------------------------

@query
def gbt_recursive(spark, folder):
    """Boosted trees on the train days, then fourteen days forward on their own forecasts."""
    rows = demand(spark, folder, CUT)
    train = rows.where(F.col(DATE) < F.lit(CUT.valid_from))
    frame = stage(feat.template_features(train, CUT), "train")
    return trees.recursive_boosted(frame, train, feat.year_frequency(frame), CUT, SHALLOW_BOOST)


@query
def gbt_recursive_means(spark, folder):
    """A tree without a split predicts the mean; trained again each round on its own forecasts, it still does."""
    cfg = replace(CUT, horizons=3)
    rows = demand(spark, folder, CUT)
    train = rows.where(F.col(DATE) < F.lit(CUT.valid_from))
    frame = stage(feat.template_features(train, cfg), "train")
    both = [trees.recursive_boosted(frame, train, feat.year_frequency(frame), cfg, STUMP, refit=refit).withColumn("refit", F.lit(refit)) for refit in (False, True)]
    return rounded(both[0].unionByName(both[1]))


@query
def gbt_warm_means(spark, folder):
    """A model of means that goes on each round from the one before, on all center's forecasts so far, stays at the mean."""
    cfg = replace(CUT, horizons=3)
    train = demand(spark, folder, CUT).where(F.col(DATE) < F.lit(CUT.valid_from))
    frame = stage(feat.template_features(train, cfg), "train")
    return rounded(trees.recursive_boosted(frame, train, feat.year_frequency(frame), cfg, STUMP, refit="warm", refit_trees=2))


@query
def gbt_recursive_warm(spark, folder):
    """Boosted trees that go on with two more trees a round, fourteen days forward."""
    train = demand(spark, folder, CUT).where(F.col(DATE) < F.lit(CUT.valid_from))
    frame = stage(feat.template_features(train, CUT), "train")
    return trees.recursive_boosted(frame, train, feat.year_frequency(frame), CUT, replace(SHALLOW_BOOST, n_estimators=PER_HORIZON_TREES), refit="warm", refit_trees=2)


@query
def gbt_per_horizon_means(spark, folder):
    """A tree with one split on one flag predicts the means of its two sides, for each horizon."""
    frame = stage(xy(spark, folder).where("split = 'train'").withColumn("weekend", (F.weekday(DATE) > 4).cast("int")), "xy")
    models = trees.fit_per_horizon(frame, ["weekend"], SPLIT_ONCE)
    sides = spark.range(2).select(F.col("id").cast("int").alias("weekend"))
    scored = trees.score_per_horizon(sides, ["weekend"], models)
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(quoted(met.prediction_name(h))).alias("yhat")) for h in range(1, 15)]))
    return rounded(scored.select("weekend", cells.alias("c")).select("weekend", "c.*"))


@query
def rf_means(spark, folder):
    """A forest of one whole-sample tree with one split on a one-hot flag predicts the means of its sides."""
    frame = stage(demand(spark, folder, CUT).withColumn("weekend", (F.weekday(DATE) > 4).cast("int")), "frame")
    sides = spark.range(2).select(F.col("id").cast("int").alias("weekend"))
    _, scored = trees.pooled_forest(frame, sides, ["weekend"], [], trees=1, depth=1, bootstrap=False)
    return rounded(scored.select(F.col("weekend").cast("int").alias("weekend"), F.col("prediction").alias("yhat")))


@query
def one_hot_centers(spark, folder):
    """One-hot vectors of all centers, learned where the number is below 20: the others are all zeros."""
    rows = demand(spark, folder, CUT).groupBy(CENTER).agg(F.count("*").alias(QTY)).withColumn("one", F.lit(1.0))
    _, scored = trees.pooled_forest(rows.where(F.col(CENTER) < 20), rows, [CENTER], ["one"], trees=1, depth=1)
    bits = F.transform(vector_to_array(f"{CENTER}_hot"), lambda x: x.cast("int").cast("string"))
    return scored.select(F.col(CENTER).cast("bigint").alias(CENTER), F.array_join(bits, "").alias("hot"))


@query
def importance_of_one_split(spark, folder):
    """All importance goes to the only feature that varies."""
    frame = demand(spark, folder, CUT).withColumns({"weekend": (F.weekday(DATE) > 4).cast("int"), "one": F.lit(1)})
    return rounded(trees.feature_importance(frame, ["one", "weekend"], trees=1, depth=1))


@query
def gbt_per_horizon(spark, folder):
    """An independent boosted model per horizon, errors on validation days."""
    columns = lag_names()
    frame = stage(xy(spark, folder), "xy")
    models = trees.fit_per_horizon(frame.where("split = 'train'"), columns, replace(SHALLOW_BOOST, n_estimators=PER_HORIZON_TREES))
    scored = trees.score_per_horizon(frame.where("split = 'valid'"), columns, models)
    return rounded(met.error_metrics(met.long_pairs(scored, [splits.SPLIT]), [splits.SPLIT]))


@query
def rf_pooled(spark, folder):
    """Forest over all centers with one-hot categories, errors on validation days."""
    rows = demand(spark, folder, CUT)
    frame = stage(plain(feat.transformed(feat.multi_center_features(rows, CUT), CUT)), "frame")
    categorical = ["is_national_holiday", "is_state_holiday", CENTER]
    numeric = [c for c in profile.numeric_columns(frame) if c not in (*categorical, QTY)]
    _, scored = trees.pooled_forest(frame.where("split = 'train'"), frame.where("split = 'valid'"),
                                    categorical, numeric, depth=FOREST_DEPTH)
    pairs = scored.select(splits.SPLIT, F.lit(1).alias("horizon"), F.col(QTY).cast("double").alias("y"),
                          F.col("prediction").alias("yhat"))
    return rounded(met.error_metrics(pairs, [splits.SPLIT]))


@query
def feature_importance(spark, folder):
    rows = demand(spark, folder, CUT)
    frame = feat.template_features(rows, CUT).where("split = 'train'")
    return rounded(trees.feature_importance(frame, trees.tree_features(CUT), trees=IMPORTANCE_TREES, depth=FOREST_DEPTH))


@query
def model_selection(spark, folder):
    """Both model families trained, forecast and compared on the same validation days."""
    return rounded(jobs.train_and_select(demand(spark, folder, CUT), CUT, SHALLOW_BOOST).metrics)


# --- planning -----------------------------------------------------------------------------------------------

@query
def two_week_demand_dc(spark, folder):
    return rounded(planning.two_week_demand(demand(spark, folder, CUT), CUT))


@query
def product_demand_from_mix(spark, folder):
    """Mix of the last three months times the units of each center's last fourteen days."""
    # One pass over the facts: everything below reads the daily table at product grain.
    grain = stage(daily.daily_demand(tables.order_items(spark, folder, "created_at", "product_id", CENTER), (CENTER, "product_id"), ALL), "demand")
    rows = stage(grain.groupBy(CENTER, DATE).agg(F.sum(QTY).alias(QTY)), "demand")
    as_of = planning.history_of(rows)[1]
    fortnight = rows.where(F.col(DATE) > F.date_sub(F.lit(as_of), 14)).groupBy(CENTER).agg(F.sum(QTY).alias("units"))
    return rounded(planning.product_demand(planning.mix_of_days(grain, rows, as_of), fortnight))


@query
def product_demand_from_forecast(spark, folder):
    """Mix of the last three months times the forecast of the next fourteen days."""
    items, rows = tables.order_items(spark, folder), demand(spark, folder)
    mix = planning.product_mix(items, rows, planning.history_of(rows)[1])
    return rounded(planning.product_demand(mix, planning.two_week_demand(rows, ALL)))


@query
def safety_stock(spark, folder):
    return rounded(planning.safety_stock(demand(spark, folder), KEYS))


@query
def order_quantity(spark, folder):
    return rounded(planning.order_quantity(demand(spark, folder), KEYS))


@query
def order_quantity_per_product(spark, folder):
    """At product grain: the facts are read once, the daily table gives the date range and the averages."""
    items, grain = tables.order_items(spark, folder, "created_at", "product_id", CENTER), (CENTER, "product_id")
    rows = stage(daily.daily_demand(items, grain, ALL), "demand")
    return rounded(planning.order_quantity(rows, grain, planning.history_of(rows)))
