"""Materialised hand-over points between the fact pass and everything built on it.

The fact tables are scanned once; the small daily table they reduce to is written to the
cluster's shared folder and read back. Later plans see its true size, survive lost executors
and never recompute the fact join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FOLDER_KEY = "spark.checkpoint.dir"

# Tables this process has staged, by Spark application.
_staged: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only when everything runs in one process."""
    folder = spark.conf.get(FOLDER_KEY, None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {FOLDER_KEY} to a folder that every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidecast-"))
    return sc.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(staged: DataFrame) -> None:
    """Deletes one table that ``stage`` wrote, once nothing will read it again."""
    spark = staged.sparkSession
    files = staged.inputFiles()
    if not files:
        return
    path = files[0].rsplit("/", 1)[0]
    files_of(spark).delete(path)
    mine = _staged.get(spark.sparkContext.applicationId, [])
    mine[:] = [p for p in mine if p.rsplit("/", 1)[1] != path.rsplit("/", 1)[1]]


@contextmanager
def dropping_staged(spark: SparkSession) -> Iterator[None]:
    """Deletes what the application stages inside the block when it ends, however it ends."""
    app = spark.sparkContext.applicationId
    before = _staged.pop(app, [])
    try:
        yield
    finally:
        drop_staged(spark)
        if before:
            _staged[app] = before


class Files:
    """Renames and deletes folders on whatever file system Spark reads. Only sessions that own a JVM have it."""

    def __init__(self, spark: SparkSession):
        jvm = getattr(spark, "_jvm", None)
        if jvm is None:
            raise RuntimeError("folders can be renamed and deleted in a classic Spark session only")
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self._path(path)
        return target, target.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        target, system = self._at(path)
        return system.exists(target)

    def delete(self, path: str) -> None:
        target, system = self._at(path)
        system.delete(target, True)

    def rename(self, path: str, to: str) -> None:
        target, system = self._at(path)
        if not system.rename(target, self._path(to)):
            raise OSError(f"could not rename {path} to {to}")

    def replace(self, fresh: str, path: str, aside: str) -> None:
        """``fresh`` takes the place of ``path``, which comes back if that fails and goes otherwise."""
        had = self.exists(path)
        if had:
            self.rename(path, aside)
        try:
            self.rename(fresh, path)
        except BaseException:
            if had:
                self.rename(aside, path)
            raise
        if had:
            self.delete(aside)


def files_of(spark: SparkSession) -> Files:
    return Files(spark)


def drop_staged(spark: SparkSession) -> int:
    """Deletes the tables this application staged, at the end of a job; frames on them stop working."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        files_of(spark).delete(path)
    return len(paths)
