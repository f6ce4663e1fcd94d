"""Running totals over a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.staging import stage

_BUCKET = "__bucket"


def running_total(df: DataFrame, order: list[Column], value: str, total: str = "running",
                  within: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and including this one, and ``<total>_all``.

    ``order`` must be unique (per ``within`` group), which also keeps the ranges even: rows are
    range-partitioned by (within, order), each range sums on its own, and the totals of the
    earlier ranges are added. Only those range totals pass through a single window partition.
    The range table is staged, since a second evaluation could draw other boundaries.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) for c in within]
    ranged = stage(df.repartitionByRange(n, *by, *order).withColumn(_BUCKET, F.spark_partition_id()), "ranges")

    sums = ranged.groupBy(*within, _BUCKET).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*within).orderBy(_BUCKET)
    offsets = sums.select(
        *within, _BUCKET,
        F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__sum").over(Window.partitionBy(*within)).alias(f"{total}_all"),
    )
    if not within:
        # One row per range, as many as there are shuffle partitions.
        offsets = F.broadcast(offsets)
    local = Window.partitionBy(*within, _BUCKET).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumn(total, F.sum(value).over(local))
        .join(offsets, [*within, _BUCKET])
        .withColumn(total, F.col(total) + F.col("__before"))
        .drop(_BUCKET, "__before")
    )
