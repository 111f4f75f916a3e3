import datetime as dt
import math

import pandas as pd
import pytest

from riskframe.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        shuffle_partitions="4",
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def wave(n, phase=0.0, base=100.0):
    """A price path with trends and reversals, without randomness."""
    return [base * (1 + 0.2 * math.sin(i / 7 + phase) + 0.05 * math.sin(i * 1.7 + phase) + i / 500) for i in range(n)]


def bars_frame(paths):
    """Bars of {symbol: closes}, high and low around the close."""
    rows = []
    for symbol, closes in paths.items():
        for day, close in zip(days(len(closes)), closes):
            if close is not None:
                rows.append((symbol, day, close * 0.99, close * 1.02, close * 0.97, close, int(100 + 37 * math.sin(close))))
    return pd.DataFrame(rows, columns=["symbol", "date", "open", "high", "low", "close", "volume"])


@pytest.fixture()
def make_bars(spark):
    def make(paths):
        return spark.createDataFrame(
            bars_frame(paths),
            "symbol string, date date, open double, high double, low double, close double, volume bigint",
        )

    return make
