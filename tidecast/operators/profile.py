"""Table profiles: frequencies, distinct values, descriptions, concentration.

Every report goes through frequency tables: equal values meet map side first, so a value that
fills a third of a column moves as one row per task, and no task ever holds a whole column.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.config import quoted
from tidecast.operators.ranking import running_total
from tidecast.staging import stage


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def schema_rows(df: DataFrame) -> DataFrame:
    """(position, column, type, is_numeric), straight from the schema."""
    rows = [(i, f.name, f.dataType.simpleString(), isinstance(f.dataType, T.NumericType))
            for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, is_numeric boolean")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def value_counts(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    """Frequency of each value but null."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(count))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def _as_rows(one_row: DataFrame, columns: list[str], value: str) -> DataFrame:
    return one_row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(quoted(c)).alias(value)) for c in columns
    ])).alias("r")).select("r.*")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_distinct), exact, nulls not counted."""
    columns = columns or df.columns
    return _as_rows(df.agg(*[F.count_distinct(F.col(quoted(c))).alias(c) for c in columns]), columns, "n_distinct")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    return _as_rows(df.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in columns]), columns, "n_null")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier one in every column.

    The whole row is one key. With its columns as keys, rows that a join has left partitioned by one of them are grouped
    where they lie: two tables of all rows in a task, beside what the join sorts, and a hot key of the join is not cut.
    """
    return df.groupBy(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("__row")).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"))


def frequencies(df: DataFrame, columns: list[str], as_type: str) -> DataFrame:
    """(column, value, n) over several columns at once, nulls left out."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast(as_type).alias("value")) for c in columns])
    return (df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def _means(counted: DataFrame, value: str) -> DataFrame:
    """(column, low, beyond) of a frequency table, the smallest value and how far the mean lies above it:
    one row per column, so it may be broadcast.

    Values are summed as distances from the smallest, so whole numbers of any size keep their digits.
    """
    known = counted.where(F.col(value).isNotNull())
    low = known.groupBy("column").agg(F.min(value).alias("low"))
    apart = (F.col(value) - F.col("low")).cast("double")
    return F.broadcast(known.join(F.broadcast(low), "column").groupBy("column").agg(
        F.max("low").alias("low"), (F.sum(F.col("n") * apart) / F.sum("n")).alias("beyond")))


def _moments(n: Column, value: Column) -> list[Column]:
    """Mean and sum of squared deviations, both from distances to the smallest value."""
    off = (value - F.col("low")).cast("double") - F.col("beyond")
    return [(F.max("low").cast("double") + F.max("beyond")).alias("mean"), F.sum(n * off * off).alias("spread")]


def describe_numeric(df: DataFrame, columns: list[str] | None = None,
                     quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), exact: bool = False) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) with exact, interpolated quantiles.

    Deviations are taken from the mean, so numbers that lie close together far from zero keep
    theirs. Values are doubles; ``exact`` keeps whole numbers of up to 38 digits as they are.

    Quantiles are read off the running totals of the frequency table, which are range-partitioned,
    so neither the column nor its distinct values need to fit anywhere.
    """
    counted = stage(frequencies(df, columns or numeric_columns(df), "decimal(38,0)" if exact else "double"), "frequencies")
    ranked = running_total(counted, [F.col("value")], "n", "cum", within=("column",))
    ranked = ranked.join(_means(counted, "value"), "column")
    n, v, total = F.col("n"), F.col("value"), F.col("cum_all")
    picks = []
    for p in quantiles:
        at = F.floor((total - 1) * F.lit(p))
        name = f"q{round(p * 100)}"
        picks += [F.min(F.when(F.col("cum") > at, v)).alias(f"{name}_lo"),
                  F.min(F.when(F.col("cum") > F.least(at + 1, total - 1), v)).alias(f"{name}_hi")]
    sums = ranked.groupBy("column").agg(
        F.sum("n").alias("count"), *_moments(n, v),
        F.min("value").alias("min"), F.max("value").alias("max"), *picks)
    result = ["column", "count", "mean", F.sqrt(F.try_divide(F.col("spread"), F.col("count") - 1)).alias("std"), "min"]
    for p in quantiles:
        name = f"q{round(p * 100)}"
        at = (F.col("count") - 1) * F.lit(p)
        lo, hi, part = F.col(f"{name}_lo"), F.col(f"{name}_hi"), at - F.floor(at)
        result.append((lo + (part.cast("decimal(7,6)") if exact else part) * (hi - lo)).alias(name))
    return sums.select(*result, "max")


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, n_unique, top, freq); equally frequent values resolve to the smallest."""
    return frequencies(df, columns, "string").groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("n_unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("freq"))


def histogram(df: DataFrame, column: str, width: float, start: float = 0.0) -> DataFrame:
    """(bin, bin_from, n) of the filled bins."""
    binned = df.where(F.col(quoted(column)).isNotNull()).select(
        F.floor((F.col(quoted(column)) - start) / width).alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.lit(start) + F.col("bin") * width).cast("double").alias("bin_from"), "n")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, type, n_rows, n_null, n_distinct, min, max, mean, std, top) of every column.

    One scan and one shuffle of frequencies for all columns. ``min`` and ``max`` are numeric for
    numeric columns only; ``top`` is the most frequent value as text.
    """
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema}
    cells = F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(kinds[c].simpleString()).alias("type"),
        F.col(quoted(c)).cast("string").alias("value"),
        (F.col(quoted(c)).cast("double") if isinstance(kinds[c], T.NumericType)
         else F.lit(None).cast("double")).alias("x"),
    ) for c in columns])
    counted = stage(df.select(F.explode(cells).alias("c")).select("c.*").groupBy("column", "type", "value", "x").agg(
        F.count(F.lit(1)).alias("n")), "frequencies")
    known, n, x = F.col("value").isNotNull(), F.col("n"), F.col("x")
    sums = counted.join(_means(counted, "x"), "column", "left").groupBy("column", "type").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("n_null"),
        F.count_if(known).alias("n_distinct"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.sum(F.when(x.isNotNull(), n)).alias("m"), *_moments(n, x),
        F.min_by("value", F.when(known, F.struct(-n, F.col("value")))).alias("top"))
    return sums.select("column", "type", "n_rows", "n_null", "n_distinct", "min", "max", "mean",
                       F.sqrt(F.try_divide(F.col("spread"), F.col("m") - 1)).alias("std"), "top")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every pair of columns, in one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(F.col(quoted(a)).cast("double"), F.col(quoted(b)).cast("double")).alias(f"c{i}")
                   for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def pareto(counts: DataFrame, key: str, count: str = "n") -> DataFrame:
    """(key, n, running, running_all, share): cumulative share of units, largest first, ties by key."""
    ranked = running_total(counts.select(key, count), [F.col(count).desc(), F.col(key)], count)
    return ranked.select(key, count, "running", "running_all", (F.col("running") / F.col("running_all")).alias("share"))


def concentration(pareto_rows: DataFrame, count: str = "n", level: float = 0.8) -> DataFrame:
    """How many of the keys, counted from the largest, it takes to reach ``level`` of all units; exact for whole units."""
    part = Fraction(str(level))
    exact = lambda c, by: c.cast("decimal(28,6)") * F.lit(by)
    needed = exact(F.col("running") - F.col(count), part.denominator) < exact(F.col("running_all"), part.numerator)
    return pareto_rows.agg(F.count_if(needed).alias("n_needed"), F.count(F.lit(1)).alias("n_keys")).withColumn(
        "needed_share", F.col("n_needed") / F.col("n_keys"))


def preview(df: DataFrame, n: int, order_by: list) -> DataFrame:
    """First ``n`` rows in a stated order (a distributed top-n, not a full sort)."""
    return df.orderBy(*order_by).limit(n)
