import datetime as dt
import math

import duckdb
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.plans.oracle import NATIONAL


def test_calendar_columns_match_python(spark):
    days = cal.calendar(spark, dt.date(2018, 12, 25), dt.date(2026, 1, 10))
    rows = days.select("date", *[c.alias(n) for n, c in cal.calendar_columns(F.col("date")).items()],
                       cal.year_week(F.col("date")).alias("year_week"), cal.month_day(F.col("date")).alias("md")).collect()
    assert len(rows) == (dt.date(2026, 1, 10) - dt.date(2018, 12, 25)).days + 1
    for r in rows:
        d = r.date
        assert (r.year, r.month, r.day) == (d.year, d.month, d.day)
        assert r.week_of_year == d.isocalendar().week and r.day_of_week == d.weekday()
        assert r.year_week == d.strftime("%Y-%W") and r.md == d.strftime("%m-%d")


def test_national_holidays(spark):
    days = cal.calendar(spark, dt.date(1995, 1, 1), dt.date(2029, 12, 31))
    flagged = {r.date for r in days.where(cal.is_national_holiday(F.col("date")) == 1).collect()}
    observed = {d.date() for d in USFederalHolidayCalendar().holidays("1995-01-01", "2029-12-31")}
    assert observed <= flagged
    # pandas lists a moved holiday on its observed day only; the actual day counts here as well.
    extra = flagged - observed
    fixed = {(1, 1), (6, 19), (7, 4), (11, 11), (12, 25)}
    assert all((d.month, d.day) in fixed and d.weekday() >= 5 for d in extra)
    assert {dt.date(2021, 7, 5), dt.date(2021, 12, 31), dt.date(2022, 6, 20), dt.date(2021, 12, 24)} <= flagged


def test_holidays_of_2024(spark):
    dim = cal.holiday_dim(spark, 2024, 2024).collect()
    assert len(dim) == 11 and not any(r.observed for r in dim)
    assert {r.date for r in dim if r.holiday == "Thanksgiving"} == {dt.date(2024, 11, 28)}


def test_dimension_equals_predicate(spark):
    days = cal.calendar(spark, dt.date(1866, 1, 1), dt.date(2150, 12, 31))
    by_rule = {r.date for r in days.where(cal.is_national_holiday(F.col("date")) == 1).collect()}
    assert by_rule == {r.date for r in cal.holiday_dim(spark, 1866, 2150).collect()}
    assert {dt.date(1975, 7, 4), dt.date(2105, 7, 4)} <= by_rule
    assert not {dt.date(1980, 1, 21), dt.date(1965, 2, 15), dt.date(1930, 11, 27)} & by_rule and dt.date(1986, 1, 20) in by_rule


def test_holidays_follow_the_law_of_their_year(spark):
    """Veterans Day on a Monday of October from 1971 to 1977, moved holidays on their dates before 1971, nothing before its first year."""
    rows = cal.holiday_dim(spark, 1865, 2100).where("not observed").collect()
    on = {}
    for r in rows:
        on.setdefault((r.holiday, r.date.year), []).append((r.date.month, r.date.day))
    assert all(len(days) == 1 for days in on.values())
    assert on["Veterans Day", 1970] == [(11, 11)] and on["Veterans Day", 1975] == [(10, 27)] and on["Veterans Day", 1978] == [(11, 11)]
    assert on["Memorial Day", 1970] == [(5, 30)] and on["Memorial Day", 1971] == [(5, 31)] and on["Washington's Birthday", 1930] == [(2, 22)]
    assert on["Columbus Day", 1960] == [(10, 12)] and ("Columbus Day", 1936) not in on
    first = {name: min(y for n, y in on if n == name) for name, _ in on}
    assert first == {"New Year's Day": 1871, "Independence Day": 1870, "Christmas Day": 1870, "Washington's Birthday": 1879, "Memorial Day": 1888, "Labor Day": 1894,
                     "Columbus Day": 1937, "Veterans Day": 1938, "Thanksgiving": 1942, "Martin Luther King Jr. Day": 1986, "Juneteenth National Independence Day": 2021}


def test_rules_equal_their_sql_on_all_years(spark):
    days = cal.calendar(spark, dt.date(1866, 1, 1), dt.date(2100, 12, 31))
    flagged = [r[0] for r in days.orderBy("date").select(cal.is_national_holiday(F.col("date"))).collect()]
    sql = duckdb.sql(f"SELECT {NATIONAL} FROM (SELECT CAST(unnest(generate_series(DATE '1866-01-01', DATE '2100-12-31', INTERVAL 1 DAY)) AS DATE) AS date) ORDER BY date")
    assert flagged == [r[0] for r in sql.fetchall()]


def test_dimension_covers_whatever_days_there_are(spark):
    days = spark.createDataFrame([(dt.date(1975, 7, 4),), (dt.date(2104, 12, 31),), (dt.date(2105, 7, 3),), (dt.date(2105, 7, 6),), (None,)], "date date")
    hit = days.join(cal.holidays_on(days).select("date").distinct(), "date").select("date")
    by_rule = days.where(cal.is_national_holiday(F.col("date")) == 1)
    assert {r.date for r in hit.collect()} == {r.date for r in by_rule.collect()} >= {dt.date(1975, 7, 4)}
    assert cal.holidays_on(days.limit(0)).count() == 0


def test_state_holidays_are_a_parameter(spark):
    days = cal.calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    hits = days.where(cal.is_state_holiday(F.col("date")) == 1)
    assert {str(r.date)[5:] for r in hits.collect()} == {"03-04", "03-29", "07-19"}
    assert days.where(cal.is_state_holiday(F.col("date"), ("02-19",)) == 1).count() == 1
    assert days.where(cal.is_state_holiday(F.col("date"), ()) == 1).count() == 0


def test_cyclic_periods(spark):
    df = spark.createDataFrame([(3, 6, 15, 26)], "day_of_week int, month int, day int, week_of_year int")
    r = df.withColumns(cal.cyclic_columns()).collect()[0]
    for name, value, period in (("day_of_week", 3, 7), ("month", 6, 12), ("day", 15, 30), ("week_of_year", 26, 53)):
        assert math.isclose(r[f"{name}_sin"], math.sin(value * 2 * math.pi / period), abs_tol=1e-12)
        assert math.isclose(r[f"{name}_cos"], math.cos(value * 2 * math.pi / period), abs_tol=1e-12)
