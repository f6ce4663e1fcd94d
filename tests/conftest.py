import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidecast.config import CENTER, DATE, QTY, ForecastConfig  # noqa: E402
from tidecast.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cfg():
    """A year of history with splits in its last months."""
    return ForecastConfig(cutoff=dt.date(2024, 2, 16), valid_from=dt.date(2023, 11, 1), test_from=dt.date(2024, 2, 1))


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


@pytest.fixture
def series(spark):
    """series({center: [quantities]}, first day) → daily demand; None leaves the day out."""
    def build(quantities, first="2023-01-01"):
        start = day(first)
        rows = [(c, start + dt.timedelta(days=i), q)
                for c, qs in quantities.items() for i, q in enumerate(qs) if q is not None]
        return spark.createDataFrame(rows, f"{CENTER} bigint, {DATE} date, {QTY} bigint")
    return build
