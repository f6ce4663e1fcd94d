"""Saved models: numbered versions under one folder, each with a manifest of what it was trained for.

A version is a folder ``v000001`` with the model's own tables and, written last, its manifest. What has
no manifest is no version, so a save that fails is never loaded and never harms an earlier one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.config import ForecastConfig

SCHEMA = ("version int, kind string, series array<string>, lags int, horizons int, features array<string>, "
          "state_holidays array<string>, per_split boolean, year_freq_fit_on string, config_hash string")


class ConfigMismatch(ValueError):
    """A model was asked to score under settings it was not trained for."""


@dataclass(frozen=True)
class Manifest:
    """What a model takes and gives: everything that shapes its inputs and outputs."""

    version: int
    kind: str
    series: tuple[str, ...]
    lags: int
    horizons: int
    features: tuple[str, ...]
    state_holidays: tuple[str, ...]
    per_split: bool
    year_freq_fit_on: str

    @staticmethod
    def of(kind: str, cfg: ForecastConfig, features: list[str], version: int = 0) -> Manifest:
        return Manifest(version, kind, tuple(cfg.series), cfg.lags, cfg.horizons, tuple(features), tuple(cfg.state_holidays),
                        cfg.per_split, cfg.year_freq_fit_on)

    def settings(self) -> dict:
        """All but the version: equal for models that take the same rows and give the same columns."""
        return {k: list(v) if isinstance(v, tuple) else v for k, v in vars(self).items() if k != "version"}

    @property
    def config_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.settings(), sort_keys=True).encode()).hexdigest()

    def check(self, cfg: ForecastConfig, features: list[str]) -> None:
        """ConfigMismatch, naming each setting that differs, unless ``cfg`` is what the model was trained for."""
        own, asked = self.settings(), Manifest.of(self.kind, cfg, features).settings()
        wrong = [f"{k}: saved {own[k]}, asked {asked[k]}" for k in own if own[k] != asked[k]]
        if wrong:
            raise ConfigMismatch("; ".join(wrong))


def _folder(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v{version:06d}"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all published versions under ``root``."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{root.rstrip('/')}/v*/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def latest(spark: SparkSession, root: str) -> int:
    """The number of the newest version, 0 without any."""
    return manifests(spark, root).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def publish(spark: SparkSession, root: str, manifest: Manifest, write: Callable[[str], None]) -> int:
    """Writes a model by ``write(folder)`` as the next version, then its manifest; returns the version.

    A folder that an earlier, failed save left under the same number is overwritten by ``write``.
    """
    version = latest(spark, root) + 1
    write(_folder(root, version))
    settings = manifest.settings()
    row = [version, *[settings[c] for c in ("kind", "series", "lags", "horizons", "features", "state_holidays", "per_split", "year_freq_fit_on")], manifest.config_hash]
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{_folder(root, version)}/manifest")
    return version


def find(spark: SparkSession, root: str, version: int | None = None) -> tuple[Manifest, str]:
    """The manifest and folder of a version, the newest by default; FileNotFoundError without it.

    A manifest whose hash is not that of its settings was changed after it was written: ValueError.
    """
    wanted = manifests(spark, root).where(F.col("version") == (version or latest(spark, root))).first()
    if wanted is None:
        raise FileNotFoundError(f"no model version {version or ''} under {root}")
    found = wanted.asDict()
    hashed = found.pop("config_hash")
    manifest = Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})
    if manifest.config_hash != hashed:
        raise ValueError(f"the manifest of version {manifest.version} under {root} does not belong to its hash")
    return manifest, _folder(root, manifest.version)
