from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rainloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def series(spark):
    """Build ``(station, date, value)`` from {station: [values]} on consecutive days."""
    def build(values: dict[str, list], start: int = 0):
        rows = [(s, day(start + i), None if v is None else float(v)) for s, vs in values.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "station string, date date, value double")
    return build


def as_pandas(df, *order) -> pd.DataFrame:
    out = df.toPandas()
    return out.sort_values(list(order)).reset_index(drop=True) if order else out


def column(df, name, order="date"):
    return [None if pd.isna(v) else v for v in as_pandas(df, order)[name]]
