"""Distinct counts and quantiles of many columns by sketches that are kept per load and united, beside the exact forms.

The exact count spreads every fact over its columns and shuffles the distinct values. A sketch has a
fixed size whatever it has seen: facts move as one row per task, a new load is sketched alone, and the
count over any loads is that of the united sketches, off by ``error_bound`` at most in all but a few of a thousand cases.
Quantiles likewise: exact ones need a frequency table and its order over all loads, united sketches neither. The rank
of an estimate is off by ``rank_error_bound`` at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import quoted
from tidecast.operators.profile import frequencies, numeric_columns

# Registers are 2 to this power.
REGISTERS_LOG = 14
# Standard errors within which an estimate is taken to lie.
ERRORS = 4
# Size of a quantile sketch: about three times as many values are kept, however many there were.
QUANTILE_SIZE = 800


def error_bound(registers_log: int = REGISTERS_LOG) -> float:
    """The relative error that estimates keep to: ERRORS times 1.04 over the root of the registers."""
    return ERRORS * 1.04 / 2 ** (registers_log / 2)


def distinct_sketches(df: DataFrame, columns: list[str] | None = None, by: tuple[str, ...] = (), registers_log: int = REGISTERS_LOG) -> DataFrame:
    """(by, column, sketch): one row per group and column; nulls are not counted."""
    columns = columns or [c for c in df.columns if c not in by]
    one = df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(quoted(c)).cast("string"), registers_log).alias(f"__{k}") for k, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{k}").alias("sketch")) for k, c in enumerate(columns)])
    return one.select(*by, F.inline(cells))


def united_counts(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, column, n_distinct) of the union of all sketches of a column."""
    return sketches.groupBy(*by, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def rank_error_bound(size: int = QUANTILE_SIZE) -> float:
    """The error of a rank, as a share of all rows: twice the one that the sketch's authors give for 99 of 100 cases."""
    return 2 * 2.296 / size ** 0.9723


def quantile_sketches(df: DataFrame, columns: list[str] | None = None, by: tuple[str, ...] = (), size: int = QUANTILE_SIZE) -> DataFrame:
    """(by, column, sketch): one row per group and numeric column; nulls and NaN are left out, values are doubles."""
    columns = columns or [c for c in numeric_columns(df) if c not in by]
    value = lambda c: F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double"))
    one = df.groupBy(*by).agg(*[F.kll_sketch_agg_double(value(c), size).alias(f"__{k}") for k, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{k}").alias("sketch")) for k, c in enumerate(columns)])
    return one.select(*by, F.inline(cells))


def united_quantiles(sketches: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, column, count, p, value): one row per column and quantile over all sketches of the column.

    A column without values has a count of 0 and null values.
    """
    united = sketches.groupBy(*by, "column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    counted = united.withColumn("count", F.kll_sketch_get_n_double("sketch"))
    cells = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.when(
        F.col("count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias("value")) for p in quantiles])
    return counted.select(*by, "column", "count", F.inline(cells))


def rank_errors(df: DataFrame, estimates: DataFrame) -> DataFrame:
    """(column, p, count, error): how far p lies from the ranks that the estimate has in ``df``, as a share of all rows.

    ``estimates`` are rows of ``united_quantiles``, a few per column. A value that occurs often has a range of ranks.
    """
    columns = [r["column"] for r in estimates.select("column").distinct().collect()]
    counted = frequencies(df, columns, "double").where(~F.isnan("value"))
    met = counted.join(F.broadcast(estimates.select("column", "p", F.col("value").alias("estimate"))), "column")
    n, below = F.sum("n"), F.sum(F.when(F.col("value") < F.col("estimate"), F.col("n")).otherwise(0))
    upto = F.sum(F.when(F.col("value") <= F.col("estimate"), F.col("n")).otherwise(0))
    return met.groupBy("column", "p").agg(n.alias("count"), F.greatest(
        F.lit(0.0), F.first("p") - upto / n, below / n - F.first("p")).alias("error"))
