"""The everyday jobs end to end, and report names."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill import flows
from quotemill.operators import metrics as M
from quotemill.operators import positions as P
from quotemill.operators import rules as RU
from quotemill.operators import sweeps as SW
from quotemill.params import DEFAULT, Params
from quotemill.schema import display_name, with_display_names
from quotemill.sources.calendar import weekday_calendar
from tests.conftest import make_bars

TODAY = dt.date(2025, 6, 30)


@pytest.fixture(scope="module")
def panel(spark):
    frame = None
    for seed, symbol in enumerate(["SPY", "QQQ", "RSP", "XLI", "SMH", "^VIX", "SOXX"]):
        closes = (100 * np.cumprod(1 + np.random.default_rng(seed).normal(0, 0.01, 300))).tolist()
        bars = make_bars(spark, closes, symbol)
        frame = bars if frame is None else frame.unionByName(bars)
    return frame.cache()


def test_backtest(spark, panel):
    calendar = weekday_calendar(panel)
    got = flows.backtest(panel, calendar, "SPY", RU.RULES["rule09"], 1, TODAY)
    assert got["positions"].select("symbol").distinct().collect()[0][0] == "SPY"
    row = got["summary"].first()
    assert row.trades == got["positions"].filter("trade_out").count()
    assert sum(r.num_trades for r in got["yearly"].collect()) == row.trades


def test_search_and_scan(spark, panel):
    calendar = weekday_calendar(panel)
    rule = RU.RULES["rule07"]
    best = flows.search(panel, calendar, ["SPY"], rule, 1, TODAY, check_both=False)
    assert {r.symbol for r in best.collect()} == {"SPY"}
    per_axis = best.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))
    assert {r.n for r in per_axis.collect()} == {3} and per_axis.count() == 23
    rules = [RU.RULES[n] for n in ("rule02", "rule08", "rule21")]
    found = {(r.symbol, r.signal) for r in flows.scan(panel, calendar, ["SPY", "QQQ", "XLI"], rules, 1, TODAY).collect()}
    assert found == {("SPY", "rule02"), ("QQQ", "rule02"), ("SPY", "rule08"), ("QQQ", "rule08"), ("SPY", "rule21")}


def test_futures_by_their_plain_names_and_unknown_symbols(spark, panel):
    calendar = weekday_calendar(panel)
    future = panel.filter("symbol = 'QQQ'").withColumn("symbol", F.lit("NQ=F"))
    rule = next(r for r in RU.RULES.values() if "NQ" in r.symbols and r.days)
    got = flows.backtest(panel.unionByName(future), calendar, "NQ", rule, 1, TODAY)["positions"]
    assert {r.symbol for r in got.select("symbol").distinct().collect()} == {"NQ"}
    scanned = flows.scan(panel.unionByName(future), calendar, ["NQ", "QQQ"], [rule], 1, TODAY).collect()
    assert "NQ" in {r.symbol for r in scanned}
    with pytest.raises(ValueError, match="CL"):
        flows.backtest(panel, calendar, "CL", rule, 1, TODAY)


@pytest.mark.parametrize("params", [DEFAULT, Params(use_proxy=True)])
def test_every_flow_with_and_without_proxy(spark, panel, params):
    calendar, rule = weekday_calendar(panel), RU.RULES["rule07"]
    got = flows.backtest(panel, calendar, "SPY", rule, 1, TODAY, params)
    assert got["summary"].count() == 1
    sweep = flows.hold_sweep(panel, calendar, "SPY", rule, 1, 4, TODAY, params).collect()
    assert len(sweep) == len(SW.day_grid(rule, 4)) and {r.symbol for r in sweep} == {"SPY"}
    rules = [RU.RULES[n] for n in ("rule02", "rule08")]
    board = flows.rule_board(panel, calendar, "SPY", rules, 1, TODAY, params).collect()
    assert {(r.symbol, r.signal, r.subscribe) for r in board} == {("SPY", "rule02", True), ("SPY", "rule08", True)}
    board = flows.symbol_board(panel, calendar, ["SPY", "QQQ", "RSP"], rule, 1, TODAY, params)
    assert {r.symbol for r in board.collect()} == {"SPY", "QQQ"}
    latest = flows.snapshot(panel, calendar, ["SPY", "QQQ"], 1, TODAY, params).collect()
    assert {r.symbol for r in latest} == {"SPY", "QQQ"} and all(r.spy_change_pct is not None for r in latest)
    scanned = flows.scan(panel, calendar, ["SPY", "QQQ"], rules, 1, TODAY, params)
    assert flows.alerts(scanned).first().message


def test_no_trades_in_holding_and_threshold_trials(spark, panel):
    rule = RU.Rule("idle", 2, 1, (), ("close",), RU.never)
    wide = RU.with_rules(panel.filter("symbol = 'SPY'"), [rule], extra=["rsi2"])
    trials = [*SW.rule_trials([rule]), *SW.threshold_grid(rule, [SW.Axis("rsi2", 50, 50, 1)], condition="less")]
    rows = {r.indicator: r.pct_positive for r in SW.report(SW.run_trials(wide, trials)).collect()}
    assert rows == {None: None, "rsi2": 0.0}


def test_display_names(spark, panel):
    names = {
        "rsi5_gold_breadth": "RSI5GoldBreadth", "close_ema8": "Close_EMA8", "ema8_cross_up": "EMA8CrossUp", "ibr3": "IBR3",
        "volume_ema_diff": "VolumeEMADiff", "macd_hist": "MACDHist", "pct_change": "%Change", "bb_upper": "BBUpper",
        "higher_closes2": "HigherCloses2", "er": "ER", "atr20_atr50": "ATR20_ATR50", "change_velocity": "ChangeVelocity",
        "value_charts": "ValueCharts", "spy_bull": "SPYBull", "vfi80": "VFI80", "stoch_oscillator": "StochOscilator",
    }
    assert {k: display_name(k) for k in names} == names
    rule = RU.RULES["rule12"]
    shown = with_display_names(P.positions(RU.with_rules(panel, [rule]), [rule]))
    assert {"HoldLong", "LongTradeIn", "RollingPnL", "Drawdown", "TradePnL"} <= set(shown.columns)
    assert M.KEYS == ("symbol", "signal") and DEFAULT.leverage == 3
