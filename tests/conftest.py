from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from canopyflow.session import local_session  # noqa: E402

# golden monthly values, months 9..12 of 2025 then 1..8 of 2026
GOLDEN = {
    "corn2": [.28, .30, .60, .82, .80, .42, .72, .86, .80, .55, .38, .30],
    "pasture": [.60, .60, .60, .68, .68, .68, .68, .60, .60, .60, .60, .60],
    "soy": [.28, .32, .62, .84, .82, .50, .34, .30, .28, .27, .26, .26],
    "corn1": [.30, .55, .78, .85, .75, .45, .30, .28, .27, .26, .26, .28],
}
MONTH_ORDER = [9, 10, 11, 12, 1, 2, 3, 4, 5, 6, 7, 8]


def golden_rows(days=(15,), names=tuple(GOLDEN)):
    rows = []
    for name in names:
        for month, value in zip(MONTH_ORDER, GOLDEN[name]):
            for day in days:
                rows.append((name, dt.date(2025 if month >= 9 else 2026, month, day), round(value * 10000)))
    return rows


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def golden(spark):
    schema = "series_id string, obs_date date, ndvi_e4 bigint"
    return spark.createDataFrame(golden_rows(), schema)


@pytest.fixture(scope="session")
def golden_dense(spark):
    schema = "series_id string, obs_date date, ndvi_e4 bigint"
    return spark.createDataFrame(golden_rows((5, 15, 25)), schema)
