"""One local session, and a panel whose prices are known functions of code and day, with gaps, limit days and ties."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

CODES = ("000031", "002207", "300518", "600090", "688163")
HOLIDAYS = {datetime.date(2022, 5, 2), datetime.date(2022, 6, 3), datetime.date(2022, 9, 12)}


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _wave(k: int, t: np.ndarray) -> np.ndarray:
    """Noise without a generator: a few incommensurable waves, between -1 and 1."""
    return (np.sin(1.7 * t + k) + np.sin(0.31 * t * (k + 2)) + np.cos(5.13 * t + 2.2 * k)) / 3


@pytest.fixture(scope="session")
def bars() -> pd.DataFrame:
    """Five codes by 150 days: slow cycles with noise, one jump to the limit, two codes alike for a while, the last code suspended at times."""
    days = [d.date() for d in pd.bdate_range("2022-03-01", periods=156) if d.date() not in HOLIDAYS][:150]
    t = np.arange(len(days), dtype=float)
    rows = []
    for k, code in enumerate(CODES):
        close = 8.0 * (k + 1) * np.exp(0.25 * np.sin(t / (11 + 3 * k)) + 0.02 * _wave(k, t))
        close[70:] *= 1.1 if k == 1 else 1.0  # a limit day
        if k == 3:
            close[20:30] = np.round(close[20], 2)  # ties with itself
        gap = 0.01 * _wave(k + 7, t)
        open_ = np.concatenate(([close[0]], close[:-1])) * (1 + gap)
        spread = 0.004 + 0.003 * np.abs(_wave(k + 13, t))
        amount = np.round(3e6 * (k + 1) * (1.5 + _wave(k + 19, t)), 2)
        frame = pd.DataFrame({"date": days, "code": code, "open": open_, "high": np.maximum(open_, close) * (1 + spread), "low": np.minimum(open_, close) * (1 - spread), "close": close, "volume": amount / close, "amount": amount, "turnover": np.round(1.5 + _wave(k + 23, t), 4)})
        rows.append(frame[~((t % 37 > 33) & (k == 4))] if k == 4 else frame)
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="session")
def panel(spark, bars):
    return spark.createDataFrame(bars).selectExpr("cast(date as date) date", "code", "open", "high", "low", "close", "volume", "amount", "turnover").cache()
