"""Runs catalog queries and their SQL counterparts on one data folder and compares the rows.

Usage: python tests/oracle_check.py FOLDER [query …]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region", "nation", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "conversations")


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        files = path / "*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    return con


def normalised(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iu":
            df[c] = df[c].astype("Int64")
        elif df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
        elif df[c].dtype.kind in "M" or (df[c].dtype == object and len(df) and hasattr(df[c].iloc[0], "isoformat")):
            df[c] = pd.to_datetime(df[c]).dt.strftime("%Y-%m-%d %H:%M:%S")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def compare(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    a, b = normalised(spark_rows), normalised(sql_rows)
    if list(a.columns) != list(b.columns):
        return f"columns {sorted(set(a.columns) ^ set(b.columns))}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for c in a.columns:
        if {str(a[c].dtype), str(b[c].dtype)} == {"float64", "Int64"} and (a[c].isna().any() or b[c].isna().any()):
            a[c], b[c] = a[c].astype("Float64"), b[c].astype("Float64")  # whole numbers with nulls
        if str(a[c].dtype) != str(b[c].dtype) and len(a):
            return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        same = (a[c] == b[c]).fillna(False).astype(bool) | (a[c].isna() & b[c].isna())
        if a[c].dtype.kind == "f":
            same |= (a[c] - b[c]).abs() <= 1e-9
        if not same.all():
            i = int((~same).to_numpy().argmax())
            return f"{c} in row {i}: {a[c][i]!r} vs {b[c][i]!r} ({int((~same).sum())} differ)"
    return None


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidecast.session import build_session

    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    for name, sql in oracle_sql().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(queries()[name](spark, folder).toPandas(), con.execute(sql).df())
        except Exception as error:  # report and go on with the next query
            problem = str(error)[:700]
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
