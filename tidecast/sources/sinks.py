"""Tables out: demand by split, features, predictions, samples, models, run records."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from tidecast.operators.profile import preview
from tidecast.operators.splits import SPLIT
from tidecast.staging import files_of

RUN_SCHEMA = (
    "run_name string, model string, params map<string,string>, metrics map<string,double>, tags map<string,string>"
)


def _writer(df: DataFrame, fmt: str, partition_by: tuple[str, ...]) -> DataFrameWriter:
    writer = df.write.format(fmt)
    if fmt == "csv":  # as the loader reads it: a quote inside a quoted cell is written twice
        writer = writer.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return writer.partitionBy(*partition_by) if partition_by else writer


def save_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """Replaces the table at ``path`` once the new one is written; a job that fails leaves the old one as it was.

    The rows go to a folder beside it, which then takes its name, so ``df`` may read the table it
    replaces. ``fmt='csv'`` writes a header and no row index; an empty text reads back as null. A reader that lists files in the moment of the
    change may miss them; nothing else ever sees a table in part.
    """
    path = path.rstrip("/")
    fresh, old = (f"{path}__{kind}_{uuid.uuid4().hex}" for kind in ("new", "old"))
    try:
        _writer(df, fmt, partition_by).mode("errorifexists").save(fresh)
        files_of(df.sparkSession).replace(fresh, path, old)
    except BaseException:
        files_of(df.sparkSession).delete(fresh)
        raise


def replace_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...], fmt: str = "parquet") -> None:
    """Replaces those partitions of the table at ``path`` that ``df`` has rows of; the others stay.

    Spark writes to a folder of its own and moves the partitions when all tasks have ended, so a job that fails changes nothing.
    """
    _writer(df, fmt, partition_by).option("partitionOverwriteMode", "dynamic").mode("overwrite").save(path)


def save_splits(df: DataFrame, path: str) -> None:
    """Train, valid and test as partitions of one table, so that a reader of one prunes the others."""
    save_table(df, path, (SPLIT,))


def replace_splits(df: DataFrame, path: str) -> None:
    """Rewrites the splits that ``df`` has; the others stay."""
    replace_partitions(df, path, (SPLIT,))


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col(SPLIT) == split)


def save_bucketed(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int, path: str | None = None) -> None:
    """A catalog table clustered by ``keys``. Two tables with equal buckets join on those keys
    without a shuffle, which pays off for fact tables that are joined on every run."""
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def save_sample(df: DataFrame, path: str, order_by: list, n: int = 10, fmt: str = "parquet") -> None:
    """The first rows of a source, as a test fixture."""
    save_table(preview(df, n, order_by).coalesce(1), path, fmt=fmt)


def preview_view(df: DataFrame, view: str, order_by: str, n: int = 10) -> DataFrame:
    """Registers ``df`` for SQL and shows its first rows through it."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(f"SELECT * FROM {view} ORDER BY {order_by} LIMIT {int(n)}")


def save_linear(model: DataFrame, path: str) -> None:
    save_table(model, path)


def load_linear(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def record_run(spark: SparkSession, path: str, run_name: str, model: str, params: Mapping = {},
               metrics: Mapping = {}, tags: Mapping = {}) -> None:
    """Appends one training run to the runs table."""
    row = (run_name, model, {k: str(v) for k, v in params.items()},
           {k: float(v) for k, v in metrics.items()}, {k: str(v) for k, v in tags.items()})
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)
