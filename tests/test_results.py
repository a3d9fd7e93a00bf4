"""Measures, sweeps, boards and streams: each against another way to the same numbers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.functions.smoothing import Smoothing, with_smoothings
from quotemill.operators import boards as BO
from quotemill.operators import metrics as M
from quotemill.operators import positions as P
from quotemill.operators import rules as RU
from quotemill.operators import sweeps as SW
from quotemill.params import DEFAULT, Params
from quotemill.streaming.bars import drain, stream_bar_table
from quotemill.streaming.monitor import firing, read_monitor, run_monitor
from quotemill.streaming.smoothing import stream_smoothings
from tests.conftest import days, make_bars


def walk(n=260, seed=1):
    return (100 * np.cumprod(1 + np.random.default_rng(seed).normal(0, 0.012, n))).tolist()


@pytest.fixture(scope="module")
def bars(spark):
    a = make_bars(spark, walk(), "AAA", volume=np.random.default_rng(3).integers(50, 150, 260).tolist())
    b = make_bars(spark, walk(180, 2), "SPY", volume=np.random.default_rng(4).integers(50, 150, 180).tolist())
    return a.unionByName(b).cache()


RULES = ["rule07", "rule16", "rule12", "open_rule"]


def chosen():
    return [RU.RULES[n] for n in RULES]


def test_frame_measures_equal_machine_tallies(spark, bars):
    rules = chosen()
    wide = RU.with_rules(bars, rules)
    frame = M.summary(P.positions(wide, rules)).orderBy("symbol", "signal").collect()
    tally = SW.with_kelly(SW.run_trials(wide, SW.rule_trials(rules))).orderBy("symbol", "signal").collect()
    assert len(frame) == len(tally) == 8
    for a, b in zip(frame, tally):
        assert (a.symbol, a.signal, a.trades, a.positive_trades) == (b.symbol, b.signal, b.trades, b.positive_trades)
        pairs = [
            (a.last_equity, b.pnl), (a.max_dd, b.max_dd), (a.cagr, b.cagr), (a.sharpe, b.sharpe), (a.sortino, b.sortino),
            (a.kelly_pct, b.kelly),
        ]
        for x, y in pairs:
            assert (x is None and y is None) or x == pytest.approx(y, rel=1e-9)


def test_measures_by_hand(spark):
    rows = [("A", "r", d, e, t, p) for d, e, t, p in zip(days(4), [100.0, 110.0, 99.0, 99.0], [False, True, True, False], [0.0, 0.1, -0.1, 0.0])]
    frame = spark.createDataFrame(rows, "symbol string, signal string, date date, equity double, trade_out boolean, trade_pnl double")
    frame = P.with_drawdown(M.with_returns(frame))
    got = M.measure(
        frame, sharpe=M.sharpe(), sortino=M.sortino(), cagr=M.cagr(), dd=F.max("drawdown"), pct=M.pct_positive(),
        win=M.average_win(), loss=M.average_loss(), stake=M.trade_kelly(), kelly=M.kelly(),
    ).first()
    r = np.array([0.1, -0.1, 0.0])
    assert got.sharpe == pytest.approx(0.0, abs=1e-12)
    assert got.sortino == pytest.approx(0.0, abs=1e-12)
    assert got.cagr == pytest.approx(0.99 ** (252 / 4) - 1)
    assert got.dd == pytest.approx(0.1) and got.pct == 50 and got.kelly == pytest.approx(r.mean() / r.var(ddof=1), abs=1e-9)
    assert (got.win, got.loss) == pytest.approx((0.1, -0.1)) and got.stake == pytest.approx(0.0, abs=1e-9)
    year = M.yearly(frame).first()
    assert (year.num_trades, year.positive_trades) == (2, 1) and year.pnl_pct == pytest.approx(-1.0)
    same = frame.select("date", F.col("daily_return").alias("benchmark_return"))
    assert M.treynor(frame, same).first().beta == pytest.approx(1.0)
    none = same.withColumn("benchmark_return", F.lit(0.0))
    assert M.treynor(frame, none).first().treynor == 0.0


def test_flat_account_has_zero_ratios(spark, bars):
    rule = RU.Rule("idle", 2, 1, (), ("close",), RU.never)
    got = M.summary(P.positions(RU.with_rules(bars, [rule]), [rule])).first()
    assert (got.trades, got.sharpe, got.sortino, got.cagr, got.max_dd) == (0, 0.0, 0.0, 0.0, 0.0)
    assert got.pct_positive is None and got.kelly_pct is None


def test_sweep_does_not_depend_on_blocks_or_partitions(spark, bars):
    rule = RU.RULES["rule07"]
    axes = [SW.Axis("rsi2", 10, 90, 20), SW.Axis("ibr", 0.1, 0.9, 0.2)]
    trials = SW.threshold_grid(rule, axes) + SW.day_grid(rule, 4)
    wide = RU.with_rules(bars, [rule], extra=["rsi2", "ibr"]).cache()
    base = SW.report(SW.run_trials(wide, trials)).orderBy("symbol", *SW.rank_key()).collect()
    assert len(base) == 2 * (20 + 10)
    other = SW.run_trials(wide.repartition(7), trials, Params(runs_per_task=3, bars_per_step=11))
    for a, b in zip(base, SW.report(other).orderBy("symbol", *SW.rank_key()).collect()):
        for x, y in zip(a, b):
            assert x == y or x == pytest.approx(y, rel=1e-9)
    one = [t for t in trials if t.column == "rsi2" and t.value == 30 and t.condition == "less"]
    narrowed = wide.withColumn("buy_rule07", F.col("buy_rule07") & F.coalesce(F.col("rsi2") <= 30, F.lit(False)))
    direct = {r.symbol: r.pnl for r in SW.run_trials(narrowed, SW.rule_trials([rule])).collect()}
    assert {r.symbol: r.pnl for r in SW.run_trials(wide, one).collect()} == direct


def test_axes_of_the_wide_search():
    buy = SW.search_axes("buy")
    assert sum(len(a.values()) for a in buy) == 394 and len({a.column for a in buy}) == len(buy) == 62
    values = {a.column: a.values() for a in SW.search_axes("sell")}
    assert values["rsi2"] == [float(v) for v in range(50, 101, 5)] and "rsi_buy" not in values
    assert values["pct_change"][6] == 0.0 and len(values["pct_change"]) == 13
    assert {a.block for a in SW.search_axes(check_both=False)} == {"breadth"}
    assert {a.block for a in SW.search_axes(check_breadth=False)} == {"other"}


def test_axis_gates(spark, bars):
    rule = RU.RULES["rule12"]
    axes = [SW.Axis("rsi2", 50, 50, 1, first_year=2030), SW.Axis("rsi5", 50, 50, 1, first_year=2020), SW.Axis("er", 0.5, 0.5, 1, needs_volume=True)]
    renamed = bars.withColumn("symbol", F.when(F.col("symbol") == "SPY", "SOXX").otherwise(F.col("symbol")))
    wide = RU.with_rules(renamed, [rule], extra=["rsi2", "rsi5", "er"])
    got = SW.run_trials(wide, SW.threshold_grid(rule, axes), DEFAULT, axes).select("symbol", "indicator").distinct()
    assert {tuple(r) for r in got.collect()} == {("AAA", "rsi5"), ("AAA", "er"), ("SOXX", "rsi5")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        alone = SW.run_trials(wide, SW.threshold_grid(rule, axes[2:]), DEFAULT, axes[2:])
        assert {r.symbol for r in alone.collect()} == {"AAA"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_both_machines_share_one_pass(spark, bars):
    rules = [RU.RULES["rule17"], RU.RULES["open_rule"]]
    wide = RU.with_rules(bars, rules)
    for frame in (P.positions(wide, rules), SW.run_trials(wide, SW.rule_trials(rules))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FlatMapGroupsInPandas") == 2


def test_scan_alerts_and_boards(spark, bars):
    rules = [RU.RULES[n] for n in ("rule02", "rule08", "open_rule")]
    scanned = BO.scan(bars, rules).orderBy("signal").collect()
    assert [(r.symbol, r.signal) for r in scanned] == [("SPY", "open_rule"), ("SPY", "rule02"), ("SPY", "rule08")]
    quiet = spark.createDataFrame([("A", "r", False, False)], "symbol string, signal string, buy_now boolean, sell_now boolean")
    assert BO.alerts(quiet).first().message == "No signals today"
    loud = spark.createDataFrame(
        [("A", "r", True, False), ("B", "r", True, False), ("B", "q", False, True)], quiet.schema
    )
    assert BO.alerts(loud).first().message == "Buy signals: r x2; sell signals: q x1"
    board = BO.rule_board(RU.with_rules(bars, rules), rules).collect()
    assert {(r.symbol, r.subscribe) for r in board} == {("AAA", False), ("SPY", True)}


def test_proxy_tracking(spark, bars):
    rule = RU.RULES["rule12"]
    proxy = Params(use_proxy=True, proxy_column="volume_like")
    with_proxy = bars.withColumn("volume_like", F.col("close") * 2)
    own = P.positions(RU.with_rules(bars, [rule]), [rule]).orderBy("symbol", "date").collect()
    for params in (proxy, Params(use_proxy=True, split_long=True, proxy_column="volume_like")):
        got = P.positions(RU.with_rules(with_proxy, [rule], params), [rule], params).orderBy("symbol", "date").collect()
        assert [r.equity for r in got] == pytest.approx([r.equity for r in own], rel=1e-9)


def test_ledger_holds_every_exit(spark, bars):
    rules = chosen()
    frame = P.positions(RU.with_rules(bars, rules), rules)
    ledger = P.trade_ledger(frame)
    assert ledger.count() == frame.filter("trade_out").count() > 50
    timed = ledger.filter("signal = 'rule12'")
    assert timed.filter("entry_date >= exit_date OR days_in_trade > 2").count() == 0
    gain = timed.select(F.max(F.abs((F.col("trade_exit") / F.col("trade_entry") - 1) * 3 - F.col("trade_pnl")))).first()[0]
    assert gain < 1e-12


def test_stream_equals_batch_over_a_restart_and_drops_late_bars(spark, bars, tmp_path):
    specs = [Smoothing("ema8", "ema", "close", (8,)), Smoothing("rsi2", "rsi", "close", (2,))]
    source, out = str(tmp_path / "bars"), str(tmp_path / "out")
    cut = days(260)[100]
    for part in (F.col("date") < cut, F.col("date") >= cut, F.col("date") < days(260)[5]):
        bars.filter(part).write.mode("append").parquet(source)
        drain(stream_smoothings(stream_bar_table(spark, source), specs), out, out + "-checkpoint")
    got = [tuple(r) for r in spark.read.parquet(out).orderBy("symbol", "date").select("symbol", "date", "ema8", "rsi2").collect()]
    want = with_smoothings(bars, specs).orderBy("symbol", "date").select("symbol", "date", "ema8", "rsi2")
    assert got == [tuple(r) for r in want.collect()]


def test_stream_monitor_equals_batch(spark, bars, tmp_path):
    """Raw bars in four deliveries, a late one and a repeated one among them; rules of both machines."""
    rules = [RU.RULES["open_rule"], RU.RULES["rule13"], RU.RULES["rule16"]]
    source, folder, cuts = str(tmp_path / "bars"), str(tmp_path / "monitor"), [days(260)[k] for k in (90, 91, 250)]
    parts = [F.col("date") < cuts[0], F.col("date").between(cuts[0], cuts[1]), F.col("date") > cuts[2], F.col("date") <= cuts[1]]
    missed = ~(F.col("date") > cuts[1]) | (F.col("date") > cuts[2])
    for part in parts:
        bars.filter(part).write.mode("append").parquet(source)
        run_monitor(stream_bar_table(spark, source), rules, folder)
        run_monitor(stream_bar_table(spark, source), rules, folder)
    got = read_monitor(spark, folder)
    batch = P.positions(RU.with_rules(bars.filter(missed), rules), rules)
    a = got.orderBy("symbol", "signal", "date").select("symbol", "signal", "date", "buy_now", "holding", "sell_now", "trade_pnl", "equity").collect()
    b = batch.orderBy("symbol", "signal", "date").select("symbol", "signal", "date", "trade_in", "hold", "trade_out", "trade_pnl", "equity").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert firing(got).count() == batch.filter("trade_in OR trade_out").count()


def test_stream_monitor_without_bars(spark, bars, tmp_path):
    source = str(tmp_path / "bars")
    bars.limit(0).write.parquet(source)
    run_monitor(stream_bar_table(spark, source), [RU.RULES["rule16"]], str(tmp_path / "monitor"))
    assert read_monitor(spark, str(tmp_path / "monitor")).collect() == []


def test_recurrence_state_is_typed():
    """What a recurrence dumps are plain values of its declared fields, and loading them changes nothing."""
    from quotemill.functions.smoothing import Smoother

    rng = np.random.default_rng(2)
    close = np.where(rng.random(90) < 0.1, np.nan, 100 + rng.normal(0, 1, 90).cumsum())
    bars = pd.DataFrame({"close": close, "high": close + 1, "low": close - 1, "volume": 1.0})
    specs = [Smoothing("e", "ema", "close", (8,)), Smoothing("r", "rsi", "close", (5,)), Smoothing("a", "atr", "close", (20,)), Smoothing("m", "macd_hist", "close", (12, 26, 9))]
    whole = Smoother(specs).push(bars)
    for cut in (1, 7, 19, 20, 45):
        first, second = Smoother(specs), Smoother(specs)
        parts = [first.push(bars[:cut])]
        for spec in specs:
            state = first.steps[spec.name].dump()
            assert len(state) == Smoother.state_schema(spec).count(",") + 1
            assert all(x is None or type(x) in (int, float, list) for x in state)
            second.steps[spec.name].load(*state)
        parts.append(second.push(bars[cut:].reset_index(drop=True)))
        for name, values in whole.items():
            np.testing.assert_array_equal(np.concatenate([p[name] for p in parts]), values)


def test_log_scale(spark):
    from quotemill.plans.registry import log_growth

    df = spark.createDataFrame([(15000.0 * math.e,), (-1.0,)], "e double").select(log_growth("e").alias("g"))
    assert [r.g for r in df.collect()] == [pytest.approx(1.0), None]
