"""All tunable values of a forecast in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# The names of the daily-demand columns.
CENTER = "product_distribution_center_id"
CENTER_NAME = "distribution_center_name"
DATE = "date"
QTY = "qty"
STEP = "day_step"

# Month-day keys that count as state holidays by default.
STATE_HOLIDAYS = ("07-19", "03-04", "03-29")


# The two named sets of boosted-tree settings, this default and SHALLOW_BOOST below.
@dataclass(frozen=True)
class BoostParams:
    """Boosted-tree settings in the vocabulary forecasters use; see ``trees.boosted_regressor``."""

    n_estimators: int = 500
    eta: float = 0.01
    max_depth: int = 15
    subsample: float = 0.7
    colsample: float = 0.8
    seed: int = 42


# The shallow alternative setting.
SHALLOW_BOOST = BoostParams(n_estimators=100, eta=0.1, max_depth=3, subsample=0.8, colsample=0.8, seed=42)


@dataclass(frozen=True)
class ForecastConfig:
    """Dates are half-open: train < valid_from <= valid < test_from <= test < cutoff."""

    cutoff: date | None = date(2024, 2, 16)
    valid_from: date = date(2023, 11, 1)
    test_from: date = date(2024, 2, 1)
    series: tuple[str, ...] = (CENTER,)
    centers: tuple[int, ...] = ()            # empty = all
    exclude_statuses: tuple[str, ...] = ()   # empty = every status counts as demand
    lags: int = 14
    horizons: int = 14
    state_holidays: tuple[str, ...] = STATE_HOLIDAYS
    # "train": year frequencies learned on train rows; "split": each split counts its own rows.
    year_freq_fit_on: str = "train"
    # True builds gap fill, lags and steps inside each split, so each loses its first days.
    per_split: bool = False
    boost: BoostParams = field(default_factory=BoostParams)

    def __post_init__(self):
        if self.year_freq_fit_on not in ("train", "split"):
            raise ValueError("year_freq_fit_on must be 'train' or 'split'")
        if not self.valid_from < self.test_from:
            raise ValueError("valid_from must lie before test_from")


def lag_name(i: int) -> str:
    return f"{QTY}_D-{i}"


def step_lag_name(i: int) -> str:
    return f"{STEP}_D-{i}"


def target_name(h: int) -> str:
    return f"y_D+{h}"


def lag_names(n: int = 14) -> list[str]:
    return [lag_name(i) for i in range(1, n + 1)]


def step_lag_names(n: int = 14) -> list[str]:
    return [step_lag_name(i) for i in range(1, n + 1)]


def target_names(n: int = 14) -> list[str]:
    return [target_name(h) for h in range(1, n + 1)]


def quoted(name: str) -> str:
    """Column reference for names that carry '-' or '+'."""
    return f"`{name}`"
