"""Sources and relational preparation against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quotemill.operators import relational as R
from quotemill.operators.context import attach_context, build_context, context_rsis
from quotemill.operators.positions import bad_bars
from quotemill.sources import bars as B
from quotemill.sources.calendar import weekday_calendar
from quotemill.sources import sinks
from quotemill.sources.sinks import read_positions, save_bucketed_bars, write_bars, write_positions
from quotemill.operators.positions import positions
from quotemill.operators.rules import RULES, with_rules
from quotemill.plans import inputs
from quotemill.session import bucketed
from tests.conftest import SMALL, days, make_bars


def test_bar_builder_with_a_symbol_holding_a_third_of_all_records(spark):
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        symbol = "HOT" if i % 3 == 0 else f"S{rng.randrange(40)}"
        day = dt.datetime(2024, 1, 1) if symbol == "HOT" else dt.datetime(2024, 1, 1 + rng.randrange(5))
        rows.append((i, symbol, day, round(rng.uniform(90, 110), 2), float(rng.randrange(1, 9))))
    rng.shuffle(rows)
    records = spark.createDataFrame(rows, "id long, symbol string, ts timestamp, price double, size double")
    got = B.build_bars(
        records, F.col("symbol"), F.col("ts"), F.col("price"), F.col("size"), B.order_key((F.col("id"), 19))
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_min_by" in plan
    want = {}
    for i, symbol, day, price, size in sorted(rows):
        o, h, l, _, v = want.get((symbol, day.date()), (price, price, price, price, 0.0))
        want[symbol, day.date()] = (o, max(h, price), min(l, price), price, v + size)
    found = {(r.symbol, r.date): (r.open, r.high, r.low, r.close, r.volume) for r in got.collect()}
    assert found == want


def test_order_key_sorts_like_its_parts_and_refuses_overflow(spark):
    pairs = [(1, 5), (1, 40), (2, 0), (10, 99), (11, 1)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", B.order_key((F.col("a"), 4), (F.col("b"), 2)).alias("k"))
    assert [(r.a, r.b) for r in df.orderBy("k").collect()] == sorted(pairs)
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|CAST_OVERFLOW"):
        spark.range(1000, 1001).select(B.order_key((F.col("id"), 3))).collect()
    with pytest.raises(ValueError):
        B.order_key((F.lit(1), 20), (F.lit(1), 19))


def test_last_arrival_wins_among_many_copies(spark):
    bars = make_bars(spark, [10, 11, 12])
    copies = bars.crossJoin(spark.range(500).withColumnRenamed("id", "arrival"))
    copies = copies.withColumn("close", F.col("close") + F.col("arrival"))
    kept = R.keep_last_arrival(copies, "arrival").orderBy("date").collect()
    assert [r.close for r in kept] == [509, 510, 511]
    assert [r.open for r in kept] == [10, 11, 12]


def test_calendar_and_session_filter(spark, tmp_path):
    bars = make_bars(spark, range(300))
    weekend = bars.withColumn("date", F.date_add("date", 5)).filter(F.weekday("date") >= 5)
    both = bars.unionByName(weekend)
    calendar = weekday_calendar(both)
    kept = R.keep_sessions(both, calendar)
    holidays = {(1, 1), (7, 4), (12, 25)}
    assert sorted(r.date for r in kept.collect()) == sorted(d for d in days(300) if (d.month, d.day) not in holidays)
    # A stored calendar has a known size, so Spark decides on the broadcast by itself, without a job.
    calendar.write.parquet(str(tmp_path / "calendar"))
    stored = R.keep_sessions(both, spark.read.parquet(str(tmp_path / "calendar")))
    assert "BroadcastHashJoin" in stored._jdf.queryExecution().executedPlan().toString()


def test_aliases_names_and_append(spark):
    assert [R.alias_ticker(x) for x in ("NQ", "GBPUSD", "SPY")] == ["NQ=F", "GBPUSD=X", "SPY"]
    df = spark.createDataFrame([("NQ",), ("GBPUSD",), ("SPY",)], "s string")
    assert [r[0] for r in df.select(R.alias_column(F.col("s"))).collect()] == ["NQ=F", "GBPUSD=X", "SPY"]
    raw = spark.createDataFrame([("2024-01-02", 1.0)], "`Date` string, `Adj Close` double")
    named = R.drop_columns(R.normalize(raw), "adj_close", "nothing")
    assert named.columns == ["date"] and named.first().date == dt.date(2024, 1, 2)
    assert R.capitalize(spark.createDataFrame([(1,)], "SPYBull int")).columns == ["Spybull"]
    joined = R.append_all([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert sorted(map(tuple, joined.collect()), key=str) == [(1, None), (None, 2)]


def test_history_starts_at_new_year_and_filters_reach_the_scan(spark, tmp_path):
    bars = make_bars(spark, range(1, 600))
    write_bars(bars, str(tmp_path / "bars"))
    stored = B.read_bars(spark, str(tmp_path / "bars"))
    picked = B.bulk_bars(stored, ["AAA", "NQ"], 1, dt.date(2025, 6, 30))
    got = [r.date for r in picked.collect()]
    assert min(got) == dt.date(2024, 1, 1) and max(got) == dt.date(2025, 6, 30)
    plan = picked.select("close")._jdf.queryExecution().executedPlan().toString()
    assert "In(symbol, [AAA,NQ" in plan and "GreaterThanOrEqual(date,2024-01-01)" in plan
    assert "volume" not in plan.split("ReadSchema")[1]


def test_bad_bars(spark):
    bars = make_bars(spark, [10, 11, 12, 13])
    day = days(4)
    broken = bars.unionByName(bars.filter(F.col("date") == day[1]))
    broken = broken.withColumn("close", F.when(F.col("date") != day[2], F.col("close")))
    broken = broken.withColumn("low", F.when(F.col("date") == day[3], F.lit(99.0)).otherwise(F.col("low")))
    got = {r.date: (r.copies, r.null_closes, r.crossed) for r in bad_bars(broken).collect()}
    assert got == {day[1]: (2, 0, 0), day[2]: (1, 1, 0), day[3]: (1, 0, 1)}


def test_context_ratios_regime_and_late_series(spark):
    rising = [float(x) for x in range(100, 360)]
    panel = make_bars(spark, rising, "SPY").unionByName(make_bars(spark, [2 * x for x in rising], "RSP"))
    late = make_bars(spark, rising, "QQQ").filter(F.col("date") >= days(260)[200])
    context = build_context(panel.unionByName(late)).orderBy("date")
    rows = context.collect()
    assert [r.breadth for r in rows] == pytest.approx([2.0] * 260)
    assert [r.spy_bull for r in rows] == [-1] * 199 + [1] * 61
    assert rows[0].risk_breadth is None and rows[200].risk_breadth == pytest.approx(1.0)
    rsi = context_rsis(context, ["rsi2_risk_breadth", "rsi5_breadth"]).orderBy("date").collect()
    assert rsi[200].rsi2_risk_breadth is None and rsi[201].rsi2_risk_breadth == 100
    assert rsi[3].rsi5_breadth is None and rsi[4].rsi5_breadth == 100
    one = attach_context(make_bars(spark, rising, "ZZZ"), context, ["vix", "spy_bull"])
    assert one.columns[-2:] == ["vix", "spy_bull"] and one.count() == 260


def test_sinks(spark, tmp_path):
    bars = make_bars(spark, range(1, 20)).withColumn("signal", F.lit("r"))
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        write_positions(bars, path, kind)
        write_positions(bars, path, kind)
        assert read_positions(spark, path).count() == 19
        # Another rule and another symbol go beside what is there; a pair given again is replaced.
        other = bars.withColumn("signal", F.lit("other"))
        write_positions(other, path, kind)
        write_positions(bars.withColumn("symbol", F.lit("ELSE")), path, kind)
        write_positions(other.limit(5), path, kind)
        stored = read_positions(spark, path)
        assert stored.dtypes == bars.dtypes
        counts = {(r.signal, r.symbol == "ELSE"): r["count"] for r in stored.groupBy("signal", "symbol").count().collect()}
        assert sorted(counts.values()) == [5, 19, 19] and counts[("other", False)] == 5
        assert read_positions(spark, path, ["other"]).select("signal").distinct().collect() == [("other",)]
        with pytest.raises(ValueError, match="buckets"):
            write_positions(bars, path, kind, buckets=4)
        with pytest.raises(ValueError, match="columns"):
            write_positions(bars.drop("open"), path, kind)
    spark.sql("DROP TABLE IF EXISTS bucketed_bars")
    save_bucketed_bars(bars.drop("signal"), "bucketed_bars", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = spark.table("bucketed_bars").groupBy("symbol").count()
        assert "Exchange hashpartitioning" not in counted._jdf.queryExecution().executedPlan().toString()
        assert counted.first()["count"] == 19
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_bars")


def test_bucketed_bars_are_played_without_an_exchange(spark, tmp_path):
    bars = make_bars(spark, [10.0 + k % 7 for k in range(60)]).unionByName(make_bars(spark, [20.0 + k % 5 for k in range(60)], "BBB"))
    rule = RULES["rule07"]
    spark.sql("DROP TABLE IF EXISTS bucketed_plan")
    save_bucketed_bars(bars, "bucketed_plan", 4, str(tmp_path / "bucketed"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with bucketed(spark):
            played = positions(with_rules(spark.table("bucketed_plan"), [rule]), [rule])
        assert spark.conf.get("spark.quotemill.bucketed") == "false"
        assert "Exchange" not in played._jdf.queryExecution().executedPlan().toString()
        usual = positions(with_rules(bars, [rule]), [rule])
        assert "Exchange" in usual._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, played.collect())) == sorted(map(str, usual.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_plan")


def test_new_files_build_the_inputs_anew(spark, tmp_path):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    spark.read.parquet(f"{SMALL}/part.parquet").write.parquet(str(tmp_path / "part.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    first = inputs.raw_bars(spark, str(tmp_path))
    count, path = first.count(), first.inputFiles()[0]
    assert inputs.raw_bars(spark, str(tmp_path)).inputFiles()[0] == path
    later = lines.limit(5).withColumn("l_shipdate", F.lit(dt.datetime(2011, 1, 3)).cast(lines.schema["l_shipdate"].dataType))
    later.write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert inputs.raw_bars(spark, str(tmp_path)).count() > count


def test_a_write_that_dies_leaves_the_old_results(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    bars = make_bars(spark, [float(x) for x in range(1, 20)]).withColumn("signal", F.lit("a b/ü"))
    assert read_positions(spark, path).collect() == []
    write_positions(bars, path)
    old = sorted(map(tuple, read_positions(spark, path).collect()))
    broken = bars.withColumn("close", F.when(F.col("close") < 10, F.raise_error(F.lit("gone")).cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="gone"):
        write_positions(broken, path)
    assert sorted(map(tuple, read_positions(spark, path).collect())) == old

    # Dead after the rows are written, before the switch; the next write and the clean-up see nothing of it.
    monkeypatch.setattr(sinks.Manifest, "switch", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        write_positions(bars.withColumn("close", F.lit(0.0)), path)
    monkeypatch.undo()
    assert sorted(map(tuple, read_positions(spark, path).collect())) == old
    write_positions(bars.withColumn("signal", F.lit("other")), path)
    reader = read_positions(spark, path)
    writes = lambda: sorted(x.name for x in (tmp_path / "results" / "data").iterdir())
    assert len(writes()) == 3
    sinks.forget_old(spark, path)
    assert len(writes()) == 2 and reader.count() == 38

    # Two writes built on one version: the second is refused.
    manifest = sinks.Manifest(spark, path)
    version, state = manifest.current()
    manifest.switch(version, state)
    with pytest.raises(RuntimeError, match="came first"):
        manifest.switch(version, {"folders": {}})
    assert manifest.current() == (version + 1, state)


def test_the_sink_computes_its_frame_once(spark, tmp_path):
    path, seen = str(tmp_path / "results"), spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    bars = make_bars(spark, [float(x) for x in range(1, 20)]).withColumn("signal", F.lit("r"))
    for k in (1, 2):
        write_positions(bars.mapInPandas(count, bars.schema), path)
        assert seen.value == 19 * k
    assert read_positions(spark, path).count() == 19


def test_csv_is_read_by_header(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    (tmp_path / "x.csv").write_text("Date,Close,Volume,Open,High,Low,Adj Close\n2024-01-02,4,5,1,3,,9\n")
    got = B.read_bars_csv(spark, path, "AAA").first()
    assert tuple(got) == ("AAA", dt.date(2024, 1, 2), 1.0, 3.0, None, 4.0, 5.0)
    with pytest.raises(ValueError, match="symbol"):
        B.read_bars_csv(spark, path)
    (tmp_path / "y.csv").write_text("symbol,date,open,high,low,close,volume\nAAA,2024-01-02,1,2,oops,4,5\n")
    with pytest.raises(Exception, match="oops"):
        B.read_bars_csv(spark, str(tmp_path / "y.csv")).collect()


@pytest.mark.parametrize("held", ["NQ=F", "NQ"])
def test_futures_have_one_name_after_loading(spark, held):
    bars = make_bars(spark, [1, 2, 3], held).unionByName(make_bars(spark, [1, 2, 3], "AAA"))
    got = B.bulk_bars(bars, ["NQ"], 1, dt.date(2024, 6, 30)).collect()
    assert [r.symbol for r in got] == ["NQ"] * 3
    names = spark.createDataFrame([("CL=F",), ("GBPUSD=X",), ("CL",), ("AB=F",)], "s string")
    assert [r[0] for r in names.select(R.plain_column(F.col("s"))).collect()] == ["CL", "GBPUSD", "CL", "AB=F"]
