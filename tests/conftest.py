import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_bars(spark, closes, symbol="A", start="2020-01-01", volume=1000.0, days=True):
    """Bars with given closes; a bar opens at the close before it."""
    import pandas as pd

    times = pd.date_range(start, periods=len(closes), freq="D" if days else "5min")
    opens = [closes[0], *closes[:-1]]
    frame = pd.DataFrame({"symbol": symbol, "ts": times, "open": opens, "high": [max(a, b) + 0.5 for a, b in zip(opens, closes)], "low": [min(a, b) - 0.5 for a, b in zip(opens, closes)], "close": closes, "volume": volume})
    frame[["open", "high", "low", "close", "volume"]] = frame[["open", "high", "low", "close", "volume"]].astype(float)
    return spark.createDataFrame(frame, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
