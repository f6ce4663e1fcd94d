"""The three CSV sources of a forecast, validated and renamed."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tidecast.config import CENTER
from tidecast.functions.calendar import utc_timestamp

log = logging.getLogger(__name__)

# Column types of the sources.
ORDER_ITEM_TYPES = {
    "id": "bigint", "order_id": "bigint", "user_id": "bigint", "product_id": "bigint",
    "inventory_item_id": "bigint", "status": "string", "created_at": "timestamp", "shipped_at": "timestamp",
    "delivered_at": "timestamp", "returned_at": "timestamp", "sale_price": "double",
}
CENTER_TYPES = {"id": "bigint", "name": "string", "latitude": "double", "longitude": "double"}
PRODUCT_TYPES = {
    "id": "bigint", "cost": "double", "category": "string", "name": "string", "brand": "string",
    "retail_price": "double", "department": "string", "sku": "string", "distribution_center_id": "bigint",
}


def _reader(spark: SparkSession, multi_line: bool = False) -> DataFrameReader:
    """A quote inside a quoted cell is written twice, as CSV has it; a backslash is a plain character."""
    return spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line)


def _schema(header: list[str], types: dict[str, str]) -> str:
    # Timestamps come in as text and are parsed afterwards; the rest is typed by the reader.
    kinds = {c: types.get(c, "string") for c in header}
    return ", ".join(f"`{c.replace('`', '``')}` {'string' if k == 'timestamp' else k}" for c, k in kinds.items())


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header. Columns named in ``types`` get that type, others stay text.

    Only the header is read up front. A leading column without a name (a written-out row index)
    is dropped. Timestamps are read as UTC whatever the session's zone. ``multi_line`` lets quoted
    cells hold line breaks; each file is then read by one task, so leave it off for large files
    without free text. Cells that do not fit their type are null; ``malformed_rows`` shows them.
    """
    header = _reader(spark, multi_line).csv(path).columns
    types = types or {}
    df = _reader(spark, multi_line).schema(_schema(header, types)).csv(path)
    if header and header[0] in ("_c0", ""):
        df = df.drop(header[0])
    stamps = {c: utc_timestamp(F.col(c)) for c in df.columns if types.get(c) == "timestamp"}
    return df.withColumns(stamps) if stamps else df


def malformed_rows(spark: SparkSession, path: str, types: dict[str, str], multi_line: bool = False) -> DataFrame:
    """(record): the raw records with a cell that does not fit its type, or with too few or too many cells."""
    header = _reader(spark, multi_line).csv(path).columns
    schema = f"{_schema(header, types)}, `__record` string"
    rows = _reader(spark, multi_line).schema(schema).options(columnNameOfCorruptRecord="__record", columnPruning=False).csv(path)
    stamps = [c for c in header if types.get(c) == "timestamp"]
    # Only cells that are asked for are parsed, so all of them are.
    every = F.length(F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in header])) >= 0
    bad = F.col("__record").isNotNull() & every
    for c in stamps:
        bad = bad | (F.col(f"`{c}`").isNotNull() & utc_timestamp(F.col(f"`{c}`")).isNull())
    return rows.where(bad).select(F.coalesce("__record", F.concat_ws(",", *[F.col(f"`{c}`") for c in stamps])).alias("record"))


def infer_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with inferred types: one extra pass over the file, for exploration only."""
    df = _reader(spark, multi_line).option("inferSchema", True).csv(path)
    return df.drop("_c0") if df.columns[:1] == ["_c0"] else df


def read_series(spark: SparkSession, path: str, date: str = "date", types: dict[str, str] | None = None) -> DataFrame:
    """CSV whose time axis becomes an ordinary date column, placed first."""
    df = read_csv(spark, path, {**(types or {}), date: "date"})
    return df.select(date, *[F.col(f"`{c}`") for c in df.columns if c != date])


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])


def rename_center_key(centers: DataFrame) -> DataFrame:
    """Prefixed centers under the key that products use; fails without an id."""
    named = prefixed(centers, "distribution_center_")
    if "distribution_center_id" not in named.columns:
        raise ValueError("column 'id' not found in the distribution centers")
    return named.withColumnRenamed("distribution_center_id", CENTER)


def load_data(spark: SparkSession, order_items_path: str, distr_centers_path: str,
              products_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(order items, distribution centers, products); the latter two with prefixed columns.

    ValueError for a path that is no text or centers without an id, FileNotFoundError for a
    missing path; every failure is logged and raised. Centers and products have free text, which
    may hold line breaks; order items have none and are read in splits.
    """
    try:
        if not all(isinstance(p, str) for p in (order_items_path, distr_centers_path, products_path)):
            raise ValueError("every path must be a string")
        items = read_csv(spark, order_items_path, ORDER_ITEM_TYPES)
        centers = rename_center_key(read_csv(spark, distr_centers_path, CENTER_TYPES, multi_line=True))
        products = prefixed(read_csv(spark, products_path, PRODUCT_TYPES, multi_line=True), "product_")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            log.error("source not found: %s", error)
            raise FileNotFoundError(str(error)) from error
        log.exception("loading failed")
        raise
    except Exception:
        log.exception("loading failed")
        raise
    log.info("sources loaded")
    return items, centers, products
