"""The catalog queries as plain SQL over the same tables, for an independent check.

Windows, cross joins and wide generated expressions are fine here: these statements run on
small data only, and state what a query means, not how to run it at scale.
"""

from __future__ import annotations

from itertools import combinations

DC = "product_distribution_center_id"
CUTOFF, VALID, TEST = "DATE '2001-08-01'", "DATE '2001-04-01'", "DATE '2001-07-01'"
EPS = "2.220446049250313e-16"
LAGS, HORIZONS = range(1, 15), range(1, 15)

ITEMS = f"""items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, o_orderstatus AS status, o_orderdate AS created_at,
         CAST(o_orderdate AS DATE) AS date, l_extendedprice AS sale_price, CAST(s_nationkey AS BIGINT) AS {DC}
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""


def daily(where: str = "TRUE") -> str:
    return f"""{ITEMS}, daily AS (
  SELECT {DC}, date, count(*) AS qty FROM items
  WHERE {DC} IS NOT NULL AND date IS NOT NULL AND {where} GROUP BY {DC}, date)"""


def dense(where: str = "TRUE") -> str:
    return f"""{daily(where)}, dense AS (
  SELECT c.{DC}, c.date, CAST(coalesce(q.qty, 0) AS BIGINT) AS qty
  FROM (SELECT {DC}, CAST(d AS DATE) AS date FROM (SELECT DISTINCT {DC} FROM daily),
        (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM daily)) c
  LEFT JOIN daily q ON q.{DC} = c.{DC} AND q.date = c.date)"""


CUT = f"date < {CUTOFF}"
SPLIT = f"CASE WHEN date < {VALID} THEN 'train' WHEN date < {TEST} THEN 'valid' ELSE 'test' END"
W = f"(PARTITION BY {DC} ORDER BY date)"
W_SPLIT = f"(PARTITION BY {DC}, split ORDER BY date)"


def lags(window: str = W, n=LAGS) -> str:
    return ", ".join(f"lag(qty, {i}) OVER {window} AS qty_d{i}" for i in n)


def leads(window: str = W) -> str:
    return ", ".join(f"lead(qty, {h - 1}) OVER {window} AS y_d{h}" for h in HORIZONS)


def step_lags(window: str = W) -> str:
    return ", ".join(f"lag(day_step, {i}) OVER {window} AS day_step_d{i}" for i in LAGS)


CALENDAR = """CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
  CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week"""


# Holidays bound to a date (key, name, first and last year) and to a weekday (month, ISO weekday, first possible day, name, years).
DATED = (("01-01", "New Year''s Day", 1871, 9999), ("02-22", "Washington''s Birthday", 1879, 1970), ("05-30", "Memorial Day", 1888, 1970),
         ("06-19", "Juneteenth National Independence Day", 2021, 9999), ("07-04", "Independence Day", 1870, 9999), ("10-12", "Columbus Day", 1937, 1970),
         ("11-11", "Veterans Day", 1938, 1970), ("11-11", "Veterans Day", 1978, 9999), ("12-25", "Christmas Day", 1870, 9999))
NTH = ((1, 1, 15, "Martin Luther King Jr. Day", 1986, 9999), (2, 1, 15, "Washington''s Birthday", 1971, 9999), (5, 1, 25, "Memorial Day", 1971, 9999),
       (9, 1, 1, "Labor Day", 1894, 9999), (10, 1, 8, "Columbus Day", 1971, 9999), (10, 1, 22, "Veterans Day", 1971, 1977), (11, 4, 22, "Thanksgiving", 1942, 9999))


def _dated(d: str) -> str:
    """The name of the holiday bound to the date ``d``, else null."""
    return "CASE " + " ".join(f"WHEN strftime({d}, '%m-%d') = '{k}' AND year({d}) BETWEEN {a} AND {b} THEN '{n}'" for k, n, a, b in DATED) + " END"


def _nth(d: str) -> str:
    return "CASE " + " ".join(f"WHEN month({d}) = {m} AND isodow({d}) = {w} AND day({d}) BETWEEN {f} AND {f + 6} AND year({d}) BETWEEN {a} AND {b} THEN '{n}'"
                              for m, w, f, n, a, b in NTH) + " END"


NATIONAL = f"""CAST(CASE WHEN {_dated('date')} IS NOT NULL OR {_nth('date')} IS NOT NULL OR (isodow(date) = 5 AND {_dated('(date + 1)')} IS NOT NULL)
  OR (isodow(date) = 1 AND {_dated('(date - 1)')} IS NOT NULL) THEN 1 ELSE 0 END AS INTEGER)"""
STATE = "CAST(CASE WHEN strftime(date, '%m-%d') IN ('07-19', '03-04', '03-29') THEN 1 ELSE 0 END AS INTEGER)"
HOLIDAYS = f"{NATIONAL} AS is_national_holiday, {STATE} AS is_state_holiday"
CYCLES = {"day_of_week": 7, "month": 12, "day": 30, "week_of_year": 53}
CYCLIC = ", ".join(f"round({fn}({c} * 2 * pi() / {p}), 9) + 0.0 AS {c}_{fn}" for c, p in CYCLES.items() for fn in ("sin", "cos"))
QTY_LAG_NAMES = ", ".join(f"qty_d{i}" for i in LAGS)
STEP_LAG_NAMES = ", ".join(f"day_step_d{i}" for i in LAGS)

FRAME = f"""{dense(CUT)}, stepped AS (
  SELECT *, CAST(row_number() OVER {W} - 1 AS BIGINT) AS day_step, {SPLIT} AS split FROM dense),
lagged AS (SELECT *, {lags()}, {step_lags()} FROM stepped),
frame AS (SELECT *, {CALENDAR}, {HOLIDAYS} FROM lagged WHERE qty_d14 IS NOT NULL)"""

SPLIT_DENSE = f"""{daily(CUT)}, lab AS (SELECT *, {SPLIT} AS split FROM daily),
b AS (SELECT split, min(date) AS lo, max(date) AS hi FROM lab GROUP BY split),
s AS (SELECT DISTINCT {DC}, split FROM lab),
g AS (SELECT {DC}, split, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
      FROM s JOIN b USING (split)),
dense AS (SELECT g.{DC}, g.split, g.date, CAST(coalesce(qty, 0) AS BIGINT) AS qty
      FROM g LEFT JOIN lab ON lab.{DC} = g.{DC} AND lab.date = g.date)"""

XY = f"""{dense(CUT)}, wide AS (SELECT *, CAST(row_number() OVER {W} AS BIGINT) AS day_step, {SPLIT} AS split,
  {lags()}, {leads()}, lead(date, 13) OVER {W} AS last_date FROM dense),
xy AS (SELECT * FROM wide WHERE qty_d14 IS NOT NULL AND y_d14 IS NOT NULL
  AND split = {SPLIT.replace('date', 'last_date')})"""


ONE = f"""{dense(CUT)}, one AS (SELECT * FROM (SELECT {DC}, date, CAST(qty AS DOUBLE) AS y, lag(qty) OVER {W} AS x,
  row_number() OVER {W} AS n, {SPLIT} AS split FROM dense) WHERE x IS NOT NULL),
fit AS (SELECT {DC}, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM one WHERE split = 'train' GROUP BY {DC})"""

def _naive(lag: int) -> str:
    return " UNION ALL ".join(
        f"SELECT 'naive_lag{lag}' AS model, split, {h} AS horizon, CAST(y_d{h} AS DOUBLE) AS y, "
        f"CAST(qty_d{lag - (h - 1) % lag} AS DOUBLE) AS yhat FROM xy" for h in HORIZONS)


PAIRS = f"{XY}, pairs AS ({_naive(1)} UNION ALL {_naive(7)})"
METRICS = """CAST(count(yhat) AS BIGINT) AS n, CAST(count(*) - count(yhat) AS BIGINT) AS unscored, round(avg(abs(y - yhat)), 6) AS mae,
  round(avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END), 6) AS mape_nonzero,
  round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse"""


def _describe(table: str, columns: dict[str, str], digits: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count({c}) AS count, round(avg({c}), {digits}) AS mean,
        round(stddev_samp({c}), {digits}) AS std, CAST(min({c}) AS DOUBLE) AS min,
        round(quantile_cont({c}, 0.25), {digits}) AS q25, round(quantile_cont({c}, 0.5), {digits}) AS q50,
        round(quantile_cont({c}, 0.75), {digits}) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {table}"""
        for name, c in columns.items())


def _freq(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns)


PRODUCTS = """products AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS category,
  p_retailprice AS retail_price FROM part)"""

RECENT = f"""bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM daily),
recent AS (SELECT {{keys}}, CAST(coalesce(sum(CASE WHEN date > hi - 90 THEN qty END), 0) AS DOUBLE)
  / least(90, max(hi) - max(lo) + 1) AS avg_qty FROM daily, bounds GROUP BY {{keys}})"""
ORDER = "CAST(ceil(round(avg_qty * 67 + avg_qty * 7, 6)) AS BIGINT) AS order_qty"

# Row t of column k is 1 for the intercept, then the lags; terms continue with the targets.
_W = ["1", *[f"qty_d{i}" for i in LAGS]]
_TERMS = [*_W, *[f"y_d{h}" for h in HORIZONS]]
STATS = " UNION ALL ".join(
    f"SELECT {DC}, CAST({t} AS INTEGER) AS term, CAST(c AS INTEGER) AS col, s AS total FROM (SELECT {DC}, "
    f"unnest(range({len(_W)})) AS c, unnest([{', '.join(f'CAST(sum({term} * {w}) AS DOUBLE)' for w in _W)}]) AS s "
    f"FROM train GROUP BY {DC})" for t, term in enumerate(_TERMS))


def _dot(h: int) -> str:
    """The stated coefficients of horizon h as double literals."""
    return f"{h / 10.0!r}e0 + " + " + ".join(f"{1.0 / (h + j)!r}e0 * qty_d{j}" for j in LAGS)


FIXED = ", ".join(
    f"round({_dot(h)}, 6) AS yhat_d{h}"
    for h in HORIZONS)
FIXED_PAIRS = " UNION ALL ".join(
    f"SELECT split, {h} AS horizon, CAST(y_d{h} AS DOUBLE) AS y, {_dot(h)} AS yhat FROM xy"
    for h in HORIZONS)

MIX = f"""bounds AS (SELECT max(date) AS hi FROM daily),
units AS (SELECT {DC}, product_id, count(*) AS units FROM items, bounds
  WHERE date > hi - INTERVAL 3 MONTH AND date <= hi GROUP BY {DC}, product_id),
fortnight AS (SELECT {DC}, sum(qty) AS expected FROM daily, bounds WHERE date > hi - 14 GROUP BY {DC}),
mix AS (SELECT *, units / sum(units) OVER (PARTITION BY {DC}) AS mix FROM units)"""

HOLIDAY_ROWS = f"""days AS (SELECT DISTINCT date FROM daily),
rules AS (
  SELECT date, {_dated('date')} AS holiday, FALSE AS observed FROM days
  UNION ALL SELECT date, {_dated('(date + s)')}, TRUE FROM days, (VALUES (5, 1), (1, -1)) v(dow, s) WHERE isodow(date) = dow
  UNION ALL SELECT date, {_nth('date')}, FALSE FROM days)"""

ORACLE = {
    "daily_demand": f"""WITH {daily()} SELECT d.{DC}, date, qty, n_name AS distribution_center_name
        FROM daily d JOIN nation ON n_nationkey = d.{DC}""",
    "daily_demand_one_dc": f"WITH {daily(f'{DC} = 1 AND {CUT}')} SELECT * FROM daily",
    "daily_demand_excl_status": f"""WITH {daily("(status IS NULL OR status <> 'F')")} SELECT * FROM daily""",
    "demand_by_region": f"""WITH {daily()} SELECT r_regionkey AS region_id, r_name AS region_name, date,
        CAST(sum(qty) AS BIGINT) AS qty FROM daily d JOIN nation ON n_nationkey = d.{DC}
        LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "orders_in_dc_list": f"WITH {daily(f'{DC} IN (1, 2, 3)')} SELECT * FROM daily",
    "demand_cutoff_split": f"WITH {daily(CUT)} SELECT *, {SPLIT} AS split FROM daily",
    "demand_year_window": f"""WITH {daily("date > DATE '2000-01-01' AND date < DATE '2001-01-01'")}
        SELECT * FROM daily""",
    "product_daily_demand": f"""WITH {ITEMS} SELECT {DC}, product_id, date, count(*) AS qty FROM items
        WHERE {DC} IS NOT NULL AND product_id IS NOT NULL AND date IS NOT NULL GROUP BY ALL""",
    "ordered_holdout_count": f"""WITH {daily()} SELECT *, CASE WHEN row_number() OVER (PARTITION BY {DC}
        ORDER BY date DESC) <= 60 THEN 'test' ELSE 'train' END AS part FROM daily""",
    "ordered_holdout_fraction": f"""WITH {daily()} SELECT *, CASE WHEN row_number() OVER (PARTITION BY {DC}
        ORDER BY date DESC) <= ceil(count(*) OVER (PARTITION BY {DC}) * 0.25) THEN 'test' ELSE 'train' END AS part
        FROM daily""",
    "dense_demand_one_series": f"WITH {dense(f'{DC} = 1')} SELECT date, qty FROM dense",
    "dense_demand_per_dc": f"WITH {dense()} SELECT * FROM dense",
    "dense_demand_per_split": f"WITH {SPLIT_DENSE} SELECT * FROM dense",
    "backfill_attributes": f"""WITH {dense()}, known AS (SELECT d.*, CASE WHEN q.qty IS NOT NULL THEN n_name END AS nm
        FROM dense d LEFT JOIN daily q ON q.{DC} = d.{DC} AND q.date = d.date
        LEFT JOIN nation ON n_nationkey = d.{DC})
        SELECT {DC}, date, qty, first_value(nm IGNORE NULLS) OVER (PARTITION BY {DC} ORDER BY date
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS distribution_center_name FROM known""",
    "features_qty_lags": f"""WITH {dense()}, l AS (SELECT *, {lags()} FROM dense)
        SELECT * FROM l WHERE qty_d14 IS NOT NULL""",
    "features_step_lags": f"""WITH {dense()}, s AS (SELECT *, row_number() OVER {W} AS day_step FROM dense),
        l AS (SELECT *, {step_lags()} FROM s) SELECT * FROM l WHERE day_step_d14 IS NOT NULL""",
    "day_step_zero_based": f"WITH {dense()} SELECT *, row_number() OVER {W} - 1 AS day_step FROM dense",
    "multistep_targets": f"""WITH {dense()}, l AS (SELECT *, {leads()} FROM dense)
        SELECT * FROM l WHERE y_d14 IS NOT NULL""",
    "aligned_xy": f"WITH {XY} SELECT * EXCLUDE (last_date) FROM xy",
    "calendar_features": f"WITH {dense()} SELECT *, {CALENDAR}, strftime(date, '%m-%d') AS month_day FROM dense",
    "year_week_key": f"""WITH {daily()} SELECT strftime(date, '%Y-%W') AS year_week, CAST(sum(qty) AS BIGINT) AS qty,
        min(date) AS first_day, max(date) AS last_day FROM daily GROUP BY 1""",
    "holiday_flags": f"""WITH {daily()} SELECT *, {HOLIDAYS},
        CAST({NATIONAL} + {STATE} AS INTEGER) AS is_holiday FROM daily""",
    "demand_on_holidays": f"""WITH {daily()}, {HOLIDAY_ROWS} SELECT holiday, observed, CAST(sum(qty) AS BIGINT) AS qty,
        count(DISTINCT date) AS n_days FROM daily JOIN rules USING (date) WHERE holiday IS NOT NULL GROUP BY ALL""",
    "cyclic_encoding": f"WITH {daily()}, c AS (SELECT *, {CALENDAR} FROM daily) SELECT *, {CYCLIC} FROM c",
    "year_frequency": f"""WITH {dense(CUT)}, s AS (SELECT *, {SPLIT} AS split, CAST(year(date) AS INTEGER) AS year
        FROM dense), f AS (SELECT year, count(*) AS n FROM s WHERE split = 'train' GROUP BY year)
        SELECT s.*, coalesce(n, 0) AS year_freq FROM s LEFT JOIN f USING (year)""",
    "log_target": f"WITH {daily()} SELECT *, round(ln(1 + qty), 9) AS qty_log1p FROM daily",
    "scaled_target": f"""WITH {daily()} SELECT *, round((qty - avg(qty) OVER ()) / stddev_pop(qty) OVER (), 6)
        AS qty_scaled FROM daily""",
    "full_features_template": f"""WITH {FRAME}, f AS (SELECT year, count(*) AS n FROM frame WHERE split = 'train'
        GROUP BY year) SELECT frame.*, is_national_holiday + is_state_holiday AS is_holiday,
        coalesce(n, 0) AS year_freq FROM frame LEFT JOIN f USING (year)""",
    "full_features_per_split": f"""WITH {SPLIT_DENSE},
        st AS (SELECT *, row_number() OVER {W_SPLIT} - 1 AS day_step FROM dense),
        lagged AS (SELECT *, {lags(W_SPLIT)}, {step_lags(W_SPLIT)} FROM st),
        frame AS (SELECT *, {CALENDAR}, {HOLIDAYS} FROM lagged WHERE qty_d14 IS NOT NULL)
        SELECT *, is_national_holiday + is_state_holiday AS is_holiday,
        count(*) OVER (PARTITION BY split, year) AS year_freq FROM frame""",
    "full_features_multi_dc": f"""WITH {FRAME} SELECT {DC}, date, qty, day_step + 1 AS day_step, {QTY_LAG_NAMES}, split,
        year, month, day, week_of_year, day_of_week, is_national_holiday, is_state_holiday FROM frame""",
    "features_transformed": f"""WITH {FRAME}, f AS (SELECT year AS y, count(*) AS n FROM frame WHERE split = 'train'
        GROUP BY year) SELECT {DC}, date, qty, day_step + 1 AS day_step, {QTY_LAG_NAMES}, split,
        coalesce(n, 0) AS year, month, day, week_of_year, day_of_week, is_national_holiday, is_state_holiday, {CYCLIC}
        FROM frame LEFT JOIN f ON frame.year = f.y""",
    "last_row_per_series": f"""WITH {dense()}, l AS (SELECT *, {lags(n=range(1, 4))} FROM dense)
        SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY {DC} ORDER BY date DESC) = 1""",
    "next_day_per_series": f"WITH {daily()} SELECT {DC}, max(date) + 1 AS next_date FROM daily GROUP BY {DC}",
    "first_last_14": f"""WITH {dense()}, r AS (SELECT *, row_number() OVER {W} AS a,
        row_number() OVER (PARTITION BY {DC} ORDER BY date DESC) AS b FROM dense)
        SELECT {DC}, date, qty, 'first' AS "end" FROM r WHERE a <= 14
        UNION ALL SELECT {DC}, date, qty, 'last' FROM r WHERE b <= 14""",
    "status_counts": f"WITH {ITEMS} SELECT status, count(*) AS n FROM items WHERE status IS NOT NULL GROUP BY status",
    "items_per_product": f"""WITH {ITEMS} SELECT product_id, count(*) AS n FROM items WHERE product_id IS NOT NULL
        GROUP BY product_id""",
    "items_per_dc": f"WITH {ITEMS} SELECT {DC}, count(*) AS n FROM items WHERE {DC} IS NOT NULL GROUP BY {DC}",
    "pareto_products": """WITH c AS (SELECT l_partkey AS product_id, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT product_id, n, CAST(sum(n) OVER w AS BIGINT) AS running,
        round(sum(n) OVER w / sum(n) OVER (), 9) AS share FROM c WINDOW w AS (ORDER BY n DESC, product_id)""",
    "pareto_concentration": """WITH c AS (SELECT l_partkey AS product_id, count(*) AS n FROM lineitem GROUP BY 1),
        r AS (SELECT n, sum(n) OVER (ORDER BY n DESC, product_id) AS running, sum(n) OVER () AS total FROM c)
        SELECT count(*) FILTER (running - n < 0.8 * total) AS n_needed, count(*) AS n_keys,
        round(count(*) FILTER (running - n < 0.8 * total) / count(*), 9) AS needed_share FROM r""",
    "distinct_counts": f"WITH {ITEMS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM items"
        for c in ("order_id", "product_id", "status", "created_at", "sale_price", DC)),
    "distinct_dcs": f"WITH {ITEMS} SELECT DISTINCT {DC} FROM items",
    "null_counts": f"WITH {ITEMS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null FROM items"
        for c in ("order_id", "product_id", "status", "created_at", "sale_price", DC)),
    "null_lags": f"WITH {dense()}, l AS (SELECT *, {lags()} FROM dense) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null FROM l"
        for c in (DC, "date", "qty", *[f"qty_d{i}" for i in LAGS])),
    "duplicate_rows": f"""WITH {ITEMS}, g AS (SELECT count(*) AS n FROM items
        GROUP BY order_id, product_id, status, created_at, sale_price, {DC})
        SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM g""",
    "describe_numeric": f"""WITH {dense()}, l AS (SELECT *, {lags()} FROM dense), r AS (SELECT *, row_number() OVER {W}
        AS day_step FROM l WHERE qty_d14 IS NOT NULL) """ + _describe(
            "r", {c: c for c in (DC, "qty", "day_step", *[f"qty_d{i}" for i in LAGS])}, 6),
    "describe_prices": f"WITH {ITEMS} " + _describe("items", {"sale_price": "sale_price"}, 4),
    "describe_categorical": f"WITH {PRODUCTS}, f AS ({_freq('products', ['name', 'brand', 'category'])}) " + """
        SELECT "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS n_unique,
        first(value ORDER BY n DESC, value) AS top, max(n) AS freq FROM f GROUP BY "column" """,
    "qty_histogram": f"""WITH {dense()} SELECT CAST(floor(qty / 2.0) AS BIGINT) AS bin,
        CAST(floor(qty / 2.0) * 2 AS DOUBLE) AS bin_from, count(*) AS n FROM dense GROUP BY 1, 2""",
    "column_profile": f"WITH {PRODUCTS}, f AS ({_freq('products', ['id', 'name', 'brand', 'category', 'retail_price'])}), " + """
        t AS (SELECT "column", first(value ORDER BY n DESC, value) AS top, count(*) AS n_distinct, sum(n) AS known
              FROM f GROUP BY "column"),
        x AS (SELECT 'id' AS "column", 'bigint' AS kind, CAST(min(id) AS DOUBLE) AS lo, CAST(max(id) AS DOUBLE) AS hi, avg(id) AS m, stddev_samp(id) AS s FROM products
              UNION ALL SELECT 'retail_price', 'double', min(retail_price), max(retail_price), avg(retail_price), stddev_samp(retail_price) FROM products)
        SELECT "column", coalesce(kind, 'string') AS type, (SELECT count(*) FROM products) AS n_rows,
        CAST((SELECT count(*) FROM products) - known AS BIGINT) AS n_null, n_distinct, round(lo, 6) AS min,
        round(hi, 6) AS max, round(m, 6) AS mean, round(s, 6) AS std, top FROM t LEFT JOIN x USING ("column")""",
    "correlation_matrix": f"""WITH {dense()}, l AS (SELECT *, {lags()} FROM dense),
        r AS (SELECT * FROM l WHERE qty_d14 IS NOT NULL) """ + " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM r"
            for a, b in combinations((DC, "qty", *[f"qty_d{i}" for i in LAGS]), 2)),
    "daily_date_bounds": f"WITH {daily()} SELECT min(date) AS first_day, max(date) AS last_day FROM daily",
    "table_shape": f"WITH {daily()} SELECT count(*) AS n_rows, CAST(3 AS INTEGER) AS n_columns FROM daily",
    "numeric_columns_profile": f"WITH {ITEMS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 2) AS mean FROM items"
        for c in ("order_id", "product_id", "sale_price", DC)),
    "demand_sorted_limit": f"WITH {daily()} SELECT * FROM daily ORDER BY qty DESC, date, {DC} LIMIT 20",
    "prefixed_products": f"WITH {PRODUCTS} SELECT " + ", ".join(
        f"{c} AS product_{c}" for c in ("id", "name", "brand", "category", "retail_price")) + " FROM products",
    "renamed_projection": f"WITH {ITEMS} SELECT order_id, product_id, {DC} AS dc_id, date FROM items",
    "constant_and_cast": f"""WITH {daily()} SELECT CAST({DC} AS VARCHAR) AS dc_text, date, CAST(0 AS INTEGER) AS zero,
        CAST(qty AS DOUBLE) AS qty_float, CAST(year(date) AS VARCHAR) AS year_text FROM daily""",
    "sql_preview": "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_partkey LIMIT 10",
    "fixture_sample": f"WITH {PRODUCTS} SELECT * FROM products ORDER BY id LIMIT 10",
    "metrics_by_model_split": f"WITH {PAIRS} SELECT model, split, {METRICS} FROM pairs GROUP BY model, split",
    "rmse_variants": f"""WITH {PAIRS}, h AS (SELECT model, split, horizon, count(*) AS n,
        sum((y - yhat) * (y - yhat)) AS sq, sum(abs(y - yhat) / greatest(abs(y), {EPS})) AS pct
        FROM pairs GROUP BY ALL)
        SELECT model, split, round(sqrt(sum(sq) / sum(n)), 6) AS rmse, round(avg(sqrt(sq / n)), 6) AS rmse_per_output,
        round(sum(pct) / sum(n) * {EPS}, 6) AS mape_eps FROM h GROUP BY model, split""",
    "best_model": f"""WITH {PAIRS}, m AS (SELECT model, split, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM pairs
        GROUP BY model, split) SELECT split, first(model ORDER BY rmse, model) AS model, round(min(rmse), 6) AS rmse
        FROM m GROUP BY split""",
    "forecast_vs_actual": f"""WITH {dense(CUT).replace("dense AS (", "dense AS MATERIALIZED (")}, week AS (
        SELECT {DC}, date, CAST(qty AS DOUBLE) AS yhat FROM dense WHERE date < {VALID} AND date >= {VALID} - 7),
        f AS MATERIALIZED (SELECT {DC}, CAST(date + 7 AS DATE) AS date, yhat FROM week UNION ALL SELECT {DC}, CAST(date + 14 AS DATE), yhat FROM week)
        SELECT f.{DC}, f.date, yhat, CAST(f.date - {VALID} + 1 AS INTEGER) AS horizon, CAST(qty AS DOUBLE) AS y
        FROM f JOIN dense d ON d.{DC} = f.{DC} AND d.date = f.date""",
    "lr_sufficient_stats": f"WITH {XY}, train AS (SELECT * FROM xy WHERE split = 'train') {STATS}",
    "lr_one_lag": f"""WITH {XY} SELECT {DC}, count(*) AS n_rows, round(regr_intercept(y_d1, qty_d1), 6) AS intercept,
        round(regr_slope(y_d1, qty_d1), 6) AS slope FROM xy WHERE split = 'train' GROUP BY {DC}""",
    "lr_fit_predict_one_lag": f"""WITH {ONE}, p AS (SELECT split, y, a + b * x AS yhat FROM one JOIN fit USING ({DC}))
        SELECT 'linear' AS model, split, {METRICS}, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse_per_output FROM p GROUP BY split""",
    "lr_pooled_one_lag": f"""WITH {ONE}, f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM one WHERE split = 'train')
        SELECT 1 AS horizon, 'intercept' AS feature, round(a, 6) AS coefficient FROM f UNION ALL SELECT 1, 'qty_D-1', round(b, 6) FROM f""",
    "lr_single_step_one_lag": f"""WITH {dense()}, o AS (SELECT *, lag(qty) OVER {W} AS x FROM dense),
        r AS (SELECT *, CAST(qty AS DOUBLE) AS y, CASE WHEN row_number() OVER (PARTITION BY {DC} ORDER BY date DESC) <= 60 THEN 'test' ELSE 'train' END AS part FROM o WHERE x IS NOT NULL),
        f AS (SELECT {DC}, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r WHERE part = 'train' GROUP BY {DC}),
        p AS (SELECT part, y, a + b * x AS yhat FROM r JOIN f USING ({DC}))
        SELECT part, {METRICS}, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse_per_output FROM p GROUP BY part""",
    "true_vs_predicted_one_lag": f"""WITH {ONE} SELECT {DC}, date, 1 AS horizon, y, round(a + b * x, 6) AS yhat
        FROM one JOIN fit USING ({DC}) WHERE split <> 'train'""",
    "batch_predict_one_lag": f"""WITH {ONE} SELECT {DC}, date, n AS day_step, x AS qty_d1, split, round(a + b * x, 6) AS y_d1
        FROM one JOIN fit USING ({DC}) WHERE split = 'test'""",
    "next_day_demand_dc": f"""WITH {ONE}, f AS (SELECT {DC}, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM one GROUP BY {DC})
        SELECT {DC}, date + 1 AS first_day, round(a + b * y, 6) AS units FROM one JOIN f USING ({DC}) WHERE date = (SELECT max(date) FROM dense)""",
    "product_demand_next_day": f"""WITH {dense()}, o AS (SELECT *, lag(qty) OVER {W} AS x FROM dense),
        f AS (SELECT {DC}, regr_slope(qty, x) AS b, regr_intercept(qty, x) AS a FROM o WHERE x IS NOT NULL GROUP BY {DC}),
        {MIX}, e AS (SELECT {DC}, a + b * qty AS expected FROM dense JOIN f USING ({DC}) WHERE date = (SELECT max(date) FROM dense))
        SELECT m.{DC}, product_id, units, round(mix, 6) AS mix, round(mix * expected, 6) AS expected_units FROM mix m JOIN e ON e.{DC} = m.{DC}""",
    "gbt_recursive_means": f"""WITH {dense(f"date < {VALID}")}, r AS (SELECT *, row_number() OVER {W} AS n FROM dense),
        m AS (SELECT avg(qty) AS yhat FROM r WHERE n > 14), l AS (SELECT max(date) AS last FROM dense)
        SELECT {DC}, CAST(h AS INTEGER) AS horizon, CAST(last + CAST(h AS INTEGER) AS DATE) AS date, round(yhat, 6) AS yhat, refit
        FROM (SELECT DISTINCT {DC} FROM dense), range(1, 4) a(h), (VALUES (TRUE), (FALSE)) b(refit), m, l""",
    "gbt_per_horizon_means": f"""WITH {XY}, t AS (SELECT *, CASE WHEN isodow(date) > 5 THEN 1 ELSE 0 END AS weekend FROM xy WHERE split = 'train') """ + " UNION ALL ".join(
        f"SELECT weekend, {h} AS horizon, round(avg(y_d{h}), 6) AS yhat FROM t GROUP BY weekend" for h in HORIZONS),
    "rf_means": f"""WITH {daily(CUT)} SELECT CASE WHEN isodow(date) > 5 THEN 1 ELSE 0 END AS weekend, round(avg(qty), 6) AS yhat FROM daily GROUP BY 1""",
    "one_hot_centers": f"""WITH {daily(CUT)}, c AS (SELECT DISTINCT {DC} FROM daily), k AS (SELECT CAST({DC} AS VARCHAR) AS name FROM c WHERE {DC} < 20)
        SELECT {DC}, (SELECT string_agg(CASE WHEN name = CAST(c.{DC} AS VARCHAR) THEN '1' ELSE '0' END, '' ORDER BY name) FROM k) AS hot FROM c""",
    "importance_of_one_split": "SELECT 'weekend' AS feature, 1.0::DOUBLE AS importance UNION ALL SELECT 'one', 0.0::DOUBLE",
    "demand_by_category": f"""WITH {ITEMS} SELECT p_type AS category, n_name AS distribution_center_name, count(*) AS units, round(sum(sale_price), 2) AS revenue
        FROM items JOIN part ON p_partkey = product_id JOIN nation ON n_nationkey = {DC} GROUP BY 1, 2""",
    "lr_normal_equations": f"""WITH {daily(CUT)} SELECT {DC}, CAST(h AS INTEGER) AS horizon, CAST(t AS INTEGER) AS term,
        CAST(0 AS DOUBLE) AS gradient FROM (SELECT DISTINCT {DC} FROM daily), range(1, 15) a(h), range(15) b(t)""",
    "lr_score_fixed_coefficients": f"""WITH {dense()}, l AS (SELECT *, {lags()} FROM dense)
        SELECT {DC}, date, {FIXED} FROM l WHERE qty_d14 IS NOT NULL""",
    "lr_metrics_fixed_coefficients": f"""WITH {XY}, pairs AS ({FIXED_PAIRS}),
        h AS (SELECT split, horizon, avg((y - yhat) * (y - yhat)) AS ms FROM pairs GROUP BY split, horizon),
        p AS (SELECT split, round(avg(sqrt(ms)), 6) AS rmse_per_output FROM h GROUP BY split),
        m AS (SELECT split, {METRICS} FROM pairs GROUP BY split)
        SELECT 'linear' AS model, m.*, rmse_per_output FROM m JOIN p USING (split)""",
    "product_demand_from_mix": f"""WITH {daily()}, {MIX} SELECT m.{DC}, product_id, units, round(mix, 6) AS mix,
        round(mix * expected, 6) AS expected_units FROM mix m JOIN fortnight f ON f.{DC} = m.{DC}""",
    "safety_stock": f"""WITH {daily()}, {RECENT.format(keys=DC)} SELECT {DC}, round(avg_qty, 6) AS avg_qty,
        round(avg_qty * 7, 6) AS safety_stock FROM recent""",
    "order_quantity": f"""WITH {daily()}, {RECENT.format(keys=DC)} SELECT {DC}, round(avg_qty, 6) AS avg_qty,
        round(avg_qty * 7, 6) AS safety_stock, {ORDER} FROM recent""",
    "order_quantity_per_product": f"""WITH {ITEMS}, daily AS (SELECT {DC}, product_id, date, count(*) AS qty FROM items
        GROUP BY ALL), {RECENT.format(keys=f'{DC}, product_id')} SELECT {DC}, product_id, round(avg_qty, 6) AS avg_qty,
        round(avg_qty * 7, 6) AS safety_stock, {ORDER} FROM recent""",
}
# Written as CSV and read back, demand is what it was.
ORACLE["demand_from_csv"] = ORACLE["daily_demand"]
# Kept by load, it is the same demand; saved and read back, it is too.
ORACLE["daily_demand_maintained"] = ORACLE["daily_demand"]
ORACLE["demand_of_replaced_splits"] = ORACLE["demand_cutoff_split"]
ORACLE["series_from_csv"] = f"WITH {daily()} SELECT * FROM daily"
ORACLE["gbt_warm_means"] = f"SELECT * EXCLUDE (refit) FROM ({ORACLE['gbt_recursive_means']}) WHERE refit"
# By SQL alone they are the same features; sketched counts are within their bound.
ORACLE["features_by_sql"] = ORACLE["features_qty_lags"]
ORACLE["demand_filled_by_sql"] = ORACLE["dense_demand_per_dc"]
ORACLE["distinct_counts_by_sketch"] = f'SELECT "column", n_distinct AS n_exact, TRUE AS within_bound FROM ({ORACLE["distinct_counts"]})'
ORACLE["quantiles_by_sketch"] = f"""WITH c AS ({ORACLE['numeric_columns_profile']})
    SELECT "column", p, n AS n_values, TRUE AS within_bound FROM c CROSS JOIN (SELECT CAST(unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS DOUBLE) AS p)"""
