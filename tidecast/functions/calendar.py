"""Column expressions on dates. Everything here runs inside generated code; no Python per row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.config import DATE, STATE_HOLIDAYS, quoted

SECONDS_PER_DAY = 86_400

# US federal holidays. Month and day of those bound to a date, with first and last year (None: still).
FIXED_HOLIDAYS = (
    (1, 1, "New Year's Day", 1871, None),
    (2, 22, "Washington's Birthday", 1879, 1970),
    (5, 30, "Memorial Day", 1888, 1970),
    (6, 19, "Juneteenth National Independence Day", 2021, None),
    (7, 4, "Independence Day", 1870, None),
    (10, 12, "Columbus Day", 1937, 1970),
    (11, 11, "Veterans Day", 1938, 1970),
    (11, 11, "Veterans Day", 1978, None),
    (12, 25, "Christmas Day", 1870, None),
)
# Month, weekday (Monday = 0) and first possible day of those bound to a weekday, with first and last year.
FLOATING_HOLIDAYS = (
    (1, 0, 15, "Martin Luther King Jr. Day", 1986, None),
    (2, 0, 15, "Washington's Birthday", 1971, None),
    (5, 0, 25, "Memorial Day", 1971, None),
    (9, 0, 1, "Labor Day", 1894, None),
    (10, 0, 8, "Columbus Day", 1971, None),
    (10, 0, 22, "Veterans Day", 1971, 1977),
    (11, 3, 22, "Thanksgiving", 1942, None),
)
# Periods of the cyclic encodings.
CYCLES = {"day_of_week": 7, "month": 12, "day": 30, "week_of_year": 53}


def utc_timestamp(text: Column) -> Column:
    """Text such as ``2024-01-13 02:51:53 UTC``, with or without microseconds, as an instant.

    Text without a zone is UTC too; text that is no timestamp gives null.
    """
    bare = F.trim(text)
    midnight = F.when(F.length(bare) == 10, F.concat(bare, F.lit(" 00:00:00"))).otherwise(bare)
    zoneless = bare.rlike(r"^\d{4}-\d{2}-\d{2}([ T][0-9:.]+)?$")
    return F.when(zoneless, F.concat(midnight, F.lit(" UTC"))).otherwise(bare).try_cast("timestamp")


def utc_date(df: DataFrame, name: str) -> Column:
    """The UTC calendar day of a column, whatever time zone the session or the JVM runs in.

    Zoneless timestamps and dates already are wall-clock values.
    """
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return col.cast("date")
    if isinstance(kind, T.StringType):
        col = utc_timestamp(col)
    return F.date_from_unix_date(F.floor(F.unix_seconds(col) / SECONDS_PER_DAY).cast("int"))


def year_week(date: Column) -> Column:
    """``%Y-%W``: weeks start on Monday, days before the first Monday are in week 00."""
    week = F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / 7).cast("string")
    return F.concat_ws("-", F.year(date).cast("string"), F.lpad(week, 2, "0"))


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")


def _in_force(year: Column, since: int, until: int | None) -> Column:
    return (year >= since) if until is None else year.between(since, until)


def _on_fixed_holiday(date: Column) -> Column:
    key, hit = F.month(date) * 100 + F.dayofmonth(date), F.lit(False)
    for m, d, _, since, until in FIXED_HOLIDAYS:
        hit = hit | ((key == m * 100 + d) & _in_force(F.year(date), since, until))
    return hit


def is_national_holiday(date: Column) -> Column:
    """1 on US federal holidays and on their observed weekday (Saturday → Friday, Sunday → Monday).

    Each rule holds from its first to its last year, so days count by the law of their time.
    """
    key, weekday = F.month(date) * 100 + F.dayofmonth(date), F.weekday(date)
    hit = _on_fixed_holiday(date)
    for m, wd, d, _, since, until in FLOATING_HOLIDAYS:
        hit = hit | ((weekday == wd) & key.between(m * 100 + d, m * 100 + d + 6) & _in_force(F.year(date), since, until))
    observed_friday = (weekday == 4) & _on_fixed_holiday(F.date_add(date, 1))
    observed_monday = (weekday == 0) & _on_fixed_holiday(F.date_sub(date, 1))
    return (hit | observed_friday | observed_monday).cast("int")


def is_state_holiday(date: Column, days: tuple[str, ...] = STATE_HOLIDAYS) -> Column:
    return month_day(date).isin(*days).cast("int") if days else F.lit(0)


def calendar(spark: SparkSession, first, last) -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(days).alias(DATE))


def holiday_dim(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Holiday dimension (date, holiday, observed) of some years: at most 16 rows a year."""
    # An observed New Year's Day may fall into the year before.
    years = spark.range(first_year, last_year + 2).select(F.col("id").cast("int").alias("year"))
    return holidays_of(years).where(F.year(DATE).between(first_year, last_year))


def holidays_on(days: DataFrame, date: str = DATE) -> DataFrame:
    """The holiday dimension of all years that ``days`` has dates in, whatever they are."""
    year = F.year(F.col(quoted(date)))
    return holidays_of(days.select(F.explode(F.array(year, year + 1)).alias("year")).where("year is not null").distinct())


def holidays_of(years: DataFrame) -> DataFrame:
    """(date, holiday, observed) for each ``year``, with days observed in the year before.

    Built forward from the rules; ``is_national_holiday`` tests a given date against the same
    rules without a join.
    """
    year = F.col("year")
    rules = [(_in_force(year, since, until), F.make_date(year, F.lit(m), F.lit(d)), name) for m, d, name, since, until in FIXED_HOLIDAYS]
    for m, wd, d, name, since, until in FLOATING_HOLIDAYS:
        start = F.make_date(year, F.lit(m), F.lit(d))
        rules.append((_in_force(year, since, until), F.date_add(start, F.pmod(F.lit(wd) - F.weekday(start), F.lit(7)).cast("int")), name))
    known = F.array(*[F.when(valid, F.struct(day.alias(DATE), F.lit(name).alias("holiday"))) for valid, day, name in rules])
    actual = years.select(F.explode(known).alias("h")).where("h is not null").select("h.*")
    # Only days bound to a date can fall on a weekend.
    moved = F.when(F.weekday(DATE) == 5, F.date_sub(F.col(DATE), 1)).when(F.weekday(DATE) == 6, F.date_add(F.col(DATE), 1))
    return (
        actual.select("holiday", F.explode(F.array(
            F.struct(F.col(DATE).alias("d"), F.lit(False).alias("observed")),
            F.struct(moved.alias("d"), F.lit(True).alias("observed")),
        )).alias("x"))
        .select(F.col("x.d").alias(DATE), "holiday", F.col("x.observed").alias("observed"))
        .where(F.col(DATE).isNotNull())
    )


def calendar_columns(date: Column) -> dict[str, Column]:
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "week_of_year": F.weekofyear(date),
        "day_of_week": F.weekday(date),
    }


def holiday_columns(date: Column, state_days: tuple[str, ...] = STATE_HOLIDAYS) -> dict[str, Column]:
    national, state = is_national_holiday(date), is_state_holiday(date, state_days)
    return {"is_national_holiday": national, "is_state_holiday": state, "is_holiday": national + state}


def cyclic_columns(periods: dict[str, int] | None = None) -> dict[str, Column]:
    """``<name>_sin`` and ``<name>_cos`` for existing numeric columns."""
    out = {}
    for name, period in (periods or CYCLES).items():
        angle = F.col(name).cast("double") * F.lit(2.0 * math.pi / period)
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    return out
