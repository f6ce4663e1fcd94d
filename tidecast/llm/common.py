"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words are runs of characters outside ASCII white space, in Spark's and in DuckDB's patterns alike.
WORD = r"[^\x20\x09-\x0D]+"


def broadcast_up_to(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; as it is beyond that."""
    return F.broadcast(df) if df.count() <= most else df
