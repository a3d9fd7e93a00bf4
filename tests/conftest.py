import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from quotemill.schema import BAR_SCHEMA  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def days(count, start=dt.date(2024, 1, 1)):
    """Weekdays from a Monday on."""
    out, day = [], start
    while len(out) < count:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


def make_bars(spark, closes, symbol="AAA", spread=1.0, volume=None):
    """Bars around the given closes; high and low lie `spread` away."""
    rows = [
        (symbol, d, float(x), float(x) + spread, float(x) - spread, float(x), float((volume or [100.0] * len(closes))[i]))
        for i, (d, x) in enumerate(zip(days(len(closes)), closes))
    ]
    return spark.createDataFrame(rows, BAR_SCHEMA)
