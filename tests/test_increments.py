"""Bars kept up to date by deliveries, against the same records built in one batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quotemill.sources import bars as B
from quotemill.sources import increments as N
from quotemill.sources import sinks

START = dt.datetime(2024, 1, 20)


def how():
    return dict(symbol=F.col("symbol"), time=F.col("ts"), price=F.col("price"), size=F.col("size"), order=B.order_key((F.col("id"), 19)))


@pytest.fixture(scope="module")
def records(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("AB"), START + dt.timedelta(days=rnd.randrange(40)), round(rnd.uniform(9, 11), 2), float(rnd.randrange(9))) for i in range(900)]
    rows.append((900, "A", None, 1.0, 1.0))
    return spark.createDataFrame(rows, "id long, symbol string, ts timestamp, price double, size double").cache()


def batch(rows):
    return sorted(map(tuple, B.build_bars(rows.where("ts IS NOT NULL"), *[how()[k] for k in ("symbol", "time", "price", "size", "order")]).select(*B.BAR_COLUMNS).collect()))


def kept(spark, path):
    return sorted(map(tuple, N.stored_bars(spark, path).collect()))


def test_any_deliveries_equal_one_batch(spark, records, tmp_path):
    path = str(tmp_path / "store")
    assert kept(spark, path) == []
    for k in range(4):
        part = records.where(F.col("id") * 7 % 4 == k)
        assert N.add_delivery(N.partials(part, **how()), path, k)
        assert not N.add_delivery(N.partials(part, **how()), path, k)
    assert N.add_delivery(N.partials(records.where("false"), **how()), path, 4)
    assert kept(spark, path) == batch(records)
    assert N.late_records(spark, path).count() == 0


def test_late_records_are_counted_and_can_be_accepted(spark, records, tmp_path):
    path = str(tmp_path / "store")
    cut = F.lit(START + dt.timedelta(days=20))
    first, late = F.col("id") % 5 != 0, (F.col("id") % 5 == 0) & (F.col("ts") < F.lit((START + dt.timedelta(days=17)).replace(hour=0)))
    N.add_delivery(N.partials(records.where(first & (F.col("ts") <= cut)), **how()), path, 0, 3)
    N.add_delivery(N.partials(records.where(~(first & (F.col("ts") <= cut))), **how()), path, 1, 3)
    assert kept(spark, path) == batch(records.where(~late))
    aside = N.late_records(spark, path)
    assert aside.agg(F.sum("records")).first()[0] == records.where(late).count() > 0
    assert {r.delivery for r in aside.select("delivery").distinct().collect()} == {1}
    assert N.accept_late(spark, path) == records.where(late).count()
    assert kept(spark, path) == batch(records) and N.late_records(spark, path).count() == 0
    assert N.accept_late(spark, path) == 0


def test_only_touched_months_move(spark, records, tmp_path):
    path = str(tmp_path / "store")
    N.add_delivery(N.partials(records, **how()), path, 0)
    before = sinks.Manifest(spark, path).current()[1]["folders"]
    N.add_delivery(N.partials(records.where(F.month("ts") == 2).withColumn("id", F.col("id") + 1000), **how()), path, 1)
    after = sinks.Manifest(spark, path).current()[1]["folders"]
    assert set(before) == set(after) == {"2024-01", "2024-02"}
    assert before["2024-01"] == after["2024-01"] and before["2024-02"] != after["2024-02"]


def test_a_delivery_that_dies_changes_nothing(spark, records, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    N.add_delivery(N.partials(records.where("id < 500"), **how()), path, 0)
    old = kept(spark, path)
    monkeypatch.setattr(N, "merged", lambda parts: parts.select(F.raise_error(F.lit("gone")).alias("date")))
    with pytest.raises(Exception, match="gone"):
        N.add_delivery(N.partials(records.where("id >= 500"), **how()), path, 1)
    monkeypatch.undo()
    assert kept(spark, path) == old
    assert N.add_delivery(N.partials(records.where("id >= 500"), **how()), path, 1)
    assert kept(spark, path) == batch(records)
