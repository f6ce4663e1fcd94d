"""Daily demand kept as partial counts: a new load of facts is counted alone and merged with what is there.

The table has one partition per load, written by ``ingest``. Counts add up, so demand is the sum over
loads; a load that is ingested again replaces itself, a correction is a load of its own with negative
units. ``compact`` sums old loads into one.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.config import CENTER, DATE, QTY, ForecastConfig
from tidecast.operators.daily import daily_demand
from tidecast.sources.sinks import replace_partitions, save_table
from tidecast.staging import stage

LOAD = "load"
# The load that compacted ones become.
BASE = "base"


def ingest(items: DataFrame, path: str, load: str, keys: tuple[str, ...] = (CENTER,), cfg: ForecastConfig | None = None,
           created_at: str = "created_at") -> None:
    """Counts the items of one load per (keys, day) and writes them as its partition; no other facts are read.

    The name of a load is a word; one that is ingested twice counts once. A load without countable
    items leaves an earlier one of its name as it is.
    """
    if not re.fullmatch(r"[\w.-]+", load) or load == BASE:
        raise ValueError(f"no name for a load: {load!r}")
    replace_partitions(daily_demand(items, keys, cfg, created_at).withColumn(LOAD, F.lit(load)), path, (LOAD,))


def partials(spark: SparkSession, path: str) -> DataFrame:
    """(keys, day, qty, load) as stored."""
    return spark.read.parquet(path)


def maintained_demand(spark: SparkSession, path: str, keys: tuple[str, ...] = (CENTER,)) -> DataFrame:
    """(keys, day, qty) over all loads: the sums of partial counts, days that corrections emptied left out."""
    return partials(spark, path).groupBy(*keys, DATE).agg(F.sum(QTY).alias(QTY)).where(F.col(QTY) != 0)


def loads(spark: SparkSession, path: str) -> list[str]:
    """Names of the loads so far, none where nothing was ingested."""
    try:
        return sorted(str(r[0]) for r in partials(spark, path).select(LOAD).distinct().collect())  # a row per load
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return []
        raise


def compact(spark: SparkSession, path: str, keys: tuple[str, ...] = (CENTER,)) -> None:
    """Sums all loads into one. The sums are written before anything is replaced, and the table changes as a whole."""
    summed = stage(maintained_demand(spark, path, keys), "compacted")
    save_table(summed.withColumn(LOAD, F.lit(BASE)), path, (LOAD,))
