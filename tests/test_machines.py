"""Position machines on short series worked by hand."""

import numpy as np
import pytest

from quotemill.operators.machines import NO_DAY, Curve, OpenMachine, Run, Tally, TimedMachine
from quotemill.params import DEFAULT, Params

FLAT = Params(leverage=1.0)


def play(machine, closes, buy, sell=None, one_day=None, runs=1):
    closes = np.array(closes, float)
    track = np.concatenate([[np.nan], closes[1:] / closes[:-1] - 1]) * machine.params.leverage
    n = len(closes)

    def grid(v):
        return np.repeat(np.array(v, bool)[:, None], runs, axis=1)

    none = [False] * n
    return machine.advance(
        closes, track, np.arange(1, n + 1), grid(buy), grid(sell or none), np.array(one_day or none, bool)
    )


def column(out, field):
    return out[field][:, 0].tolist()


def test_entry_on_first_bar_and_exit_by_days():
    out = play(TimedMachine([Run(2, 9)], FLAT), [10, 9, 8, 7, 6], [True, False, False, False, False])
    assert column(out, "trade_in") == [True, False, False, False, False]
    assert column(out, "hold") == [False, True, True, False, False]
    assert column(out, "trade_out") == [False, False, True, False, False]
    assert column(out, "days_in_trade") == [0, 1, 2, 0, 0]
    assert column(out, "equity") == pytest.approx([15000, 13500, 12000, 12000, 12000])
    assert column(out, "trade_pnl") == pytest.approx([0, -0.1, -0.2, 0, 0])


def test_exit_by_won_closes_and_no_entry_on_the_exit_bar():
    out = play(TimedMachine([Run(9, 1)], FLAT), [10, 9, 11, 12, 13], [True] * 5)
    assert column(out, "trade_out") == [False, False, True, False, True]
    assert column(out, "trade_in") == [True, False, False, True, False]
    assert column(out, "trade_entry") == [10, 10, 10, 12, 12]
    assert column(out, "entry_day") == [1, 1, 1, 4, 4]


def test_exit_by_sell_needs_a_position():
    out = play(
        TimedMachine([Run(9, 9)], FLAT), [10, 11, 12, 13], [False, True, False, False], [True, True, True, False]
    )
    assert column(out, "trade_out") == [False, False, True, False]
    assert column(out, "hold") == [False, False, True, False]


def test_short_run_earns_on_falls():
    out = play(TimedMachine([Run(9, 1, False)], DEFAULT), [10, 9, 9], [True, False, False])
    assert column(out, "trade_out") == [False, True, False]
    assert column(out, "trade_pnl") == pytest.approx([0, 0.3, 0])
    assert column(out, "equity") == pytest.approx([15000, 15000 * 1.3, 15000 * 1.3])


def test_trade_open_at_the_end_is_not_counted():
    machine, tally = TimedMachine([Run(9, 9)], FLAT), Tally(1, FLAT)
    tally.push(play(machine, [10, 9, 8], [True, False, False]))
    result = tally.result()
    assert result["trades"][0] == 0 and result["hold"][0]
    assert np.isnan(result["avg_win"][0])


def test_open_machine_ignores_the_first_bar_and_adds_results_up():
    out = play(OpenMachine([Run(0, 0)], FLAT), [10, 10, 11, 12.1, 12.1], [True, True, False, False, False], [0, 0, 0, 1, 0])
    assert column(out, "trade_in") == [False, True, False, False, False]
    assert column(out, "trade_pnl") == pytest.approx([0, 0, 0.1, 0.2, 0])
    assert column(out, "trade_out") == [False, False, False, True, False]


def test_open_machine_stops_out():
    out = play(OpenMachine([Run(0, 0)], FLAT), [10, 10, 8, 8], [False, True, False, False])
    assert column(out, "trade_out") == [False, False, True, False]
    assert column(out, "hold") == [False, False, True, False]


def test_lone_one_day_buy_lasts_one_bar():
    out = play(OpenMachine([Run(0, 0)], FLAT), [10, 9, 9, 9], [False] * 4, one_day=[False, True, False, False])
    assert column(out, "trade_in") == [False, True, False, False]
    assert column(out, "hold") == [False, False, True, False]
    assert column(out, "trade_out") == [False, False, True, False]


def test_one_day_buy_during_a_hold_keeps_the_position_over_the_exit():
    out = play(
        OpenMachine([Run(0, 0)], FLAT),
        [10, 10, 10, 10, 10],
        [False, True, False, False, False],
        sell=[False, False, True, False, False],
        one_day=[False, False, True, False, False],
    )
    assert column(out, "hold") == [False, False, True, True, True]
    assert column(out, "days_in_trade") == [0, 0, 1, 2, 3]
    assert column(out, "trade_out") == [False, False, True, False, False]


def test_limits_on_the_open_machine():
    out = play(OpenMachine([Run(1, 9)], FLAT), [10, 10, 10, 10], [False, True, False, False])
    assert column(out, "trade_out") == [False, False, True, False]


@pytest.mark.parametrize("machine", [TimedMachine, OpenMachine])
@pytest.mark.parametrize("cut", [1, 7, 50])
def test_batches_do_not_matter(machine, cut):
    rng = np.random.default_rng(3)
    n, runs = 200, [Run(d, p) for d in (1, 3, 8) for p in (1, 2)]
    close = 100 * np.cumprod(1 + rng.normal(0, 0.02, n))
    track = np.concatenate([[np.nan], close[1:] / close[:-1] - 1]) * 3
    buy, sell = rng.random((n, len(runs))) < 0.3, rng.random((n, len(runs))) < 0.1
    one_day, day = rng.random(n) < 0.1, np.arange(n)
    whole = machine(runs, DEFAULT).advance(close, track, day, buy, sell, one_day)
    parts, other = [], machine(runs, DEFAULT)
    tally, once = Tally(len(runs), DEFAULT), Tally(len(runs), DEFAULT)
    once.push(whole)
    for i in range(0, n, cut):
        s = slice(i, i + cut)
        parts.append(other.advance(close[s], track[s], day[s], buy[s], sell[s], one_day[s]))
        tally.push(parts[-1])
    for field in whole:
        np.testing.assert_array_equal(whole[field], np.concatenate([p[field] for p in parts]))
    for name, value in once.result().items():
        np.testing.assert_allclose(value.astype(float), tally.result()[name].astype(float), rtol=1e-9)
    # A flat account stays as it is, entries never overlap a hold, and no trade outlasts its limit.
    flat = ~whole["hold"][1:]
    assert (whole["equity"][1:][flat] == whole["equity"][:-1][flat]).all()
    assert not (whole["hold"] & whole["trade_in"]).any()
    if machine is TimedMachine:
        assert (whole["days_in_trade"] <= np.array([r.days for r in runs])).all()


def test_curve_peak_and_drawdown():
    peak, drawdown, returns = Curve(1).push(np.array([[100.0], [120.0], [90.0]]))
    assert peak[:, 0].tolist() == [100, 120, 120]
    assert drawdown[:, 0].tolist() == pytest.approx([0, 0, 0.25])
    assert returns[1:, 0].tolist() == pytest.approx([0.2, -0.25])


def test_ruined_account():
    tally = Tally(1, DEFAULT)
    out = play(TimedMachine([Run(9, 9)], DEFAULT), [10, 6, 6], [True, False, False])
    tally.push(out)
    result = tally.result()
    assert result["pnl"][0] < 0
    assert result["sharpe"][0] == -100
    assert np.isnan(result["cagr"][0])


@pytest.mark.parametrize("machine", [TimedMachine, OpenMachine])
def test_entry_days_before_1970(machine):
    closes, n = np.array([10.0, 10, 9, 8, 7, 6]), 6
    buy = np.array([[False], [True], [False], [False], [False], [False]])
    none = np.zeros((n, 1), bool)
    track = np.concatenate([[np.nan], closes[1:] / closes[:-1] - 1])
    out = machine([Run(2, 9)], FLAT).advance(closes, track, np.arange(-2, n - 2), buy, none, np.zeros(n, bool))
    dates = out["entry_day"][:, 0].astype("datetime64[D]")
    assert np.isnat(dates[0]) and (dates[1:4] == np.datetime64("1969-12-31")).all() and np.isnat(dates[-1])


class OpenLoop:
    """The open-ended machine bar by bar, as its definition reads."""

    def __init__(self, run, params):
        self.run, self.params = run, params
        self.p = dict(hold=False, trade_in=False, trade_out=False, days_in_trade=0, profitable_closes=0, trade_entry=0.0,
                      entry_day=NO_DAY, trade_pnl=0.0, equity=params.start_capital, buy=False, odb=False, close=np.nan)
        self.started = False

    def bar(self, close, track, day, buy, sell, odb):
        p, s = self.p, {}
        if not self.started:
            s = {**p}
        else:
            s["hold"] = h = (p["hold"] and not p["trade_out"]) or p["trade_in"] or p["odb"]
            s["trade_in"] = (buy or odb) and not h
            won = close > p["close"] if self.run.is_long else close < p["close"]
            s["days_in_trade"] = p["days_in_trade"] + 1 if h else 0
            s["profitable_closes"] = p["profitable_closes"] + won if h else 0
            opens = (s["trade_in"] or odb) and p["trade_entry"] == 0
            s["trade_entry"] = close if opens else p["trade_entry"] if h else 0.0
            s["entry_day"] = day if opens else p["entry_day"] if h else NO_DAY
            s["trade_pnl"] = p["trade_pnl"] + track if h else 0.0
            full = self.run.days > 0 and (s["days_in_trade"] >= self.run.days or s["profitable_closes"] >= self.run.profit)
            s["trade_out"] = (sell and h) or (p["odb"] and not p["hold"] and not p["buy"]) or s["trade_pnl"] < -self.params.stop_loss or full
            s["equity"] = p["equity"] * (1 + track) if h else p["equity"]
        self.started = True
        self.p = {**s, "buy": buy, "odb": odb, "close": close}
        return self.p


@pytest.mark.parametrize("many", [0, 20])
@pytest.mark.parametrize("seed", range(24))
def test_open_machine_equals_its_definition(seed, many):
    """Hold by hold, and bar by bar for all runs at once."""
    rng = np.random.default_rng(seed)
    n = 400
    runs = [Run(d, p, long) for d, p in ((0, 0), (1, 3), (5, 2), (30, 1), (3, 100)) for long in (True, False)]
    close = np.round(100 * np.cumprod(1 + rng.normal(0, 0.02, n)), 1)
    if seed % 5 == 0:
        close[rng.integers(0, n, 4)] = 0.0
    if seed % 7 == 0:
        close[rng.integers(0, n, 3)] = np.nan
    with np.errstate(divide="ignore", invalid="ignore"):
        track = np.nan_to_num(np.concatenate([[np.nan], close[1:] / close[:-1] - 1]), nan=np.nan, posinf=0.5) * 3
    buy = rng.random((n, len(runs))) < (0.02, 0.3, 0.9)[seed % 3]
    sell = rng.random((n, len(runs))) < (0.0, 0.05, 0.4)[seed // 3 % 3]
    one_day, day = rng.random(n) < (0.0, 0.1, 0.6)[seed // 2 % 3], np.arange(n) - 70
    machine = OpenMachine(runs, DEFAULT)
    machine.REACH, machine.MANY = 3, many
    cuts = (0, 1, 50, 53, 54, n)
    parts = [machine.advance(close[a:b], track[a:b], day[a:b], buy[a:b], sell[a:b], one_day[a:b]) for a, b in zip(cuts, cuts[1:])]
    for k, run in enumerate(runs):
        loop = OpenLoop(run, DEFAULT)
        want = [loop.bar(close[i], track[i], day[i], buy[i, k], sell[i, k], one_day[i]) for i in range(n)]
        for field in parts[0]:
            got = np.concatenate([p[field][:, k] for p in parts])
            np.testing.assert_array_equal(got, np.array([w[field] for w in want], got.dtype), err_msg=f"{field} {run}")


@pytest.mark.parametrize("seed", range(6))
def test_trades_equal_the_bar_loop(seed):
    rng = np.random.default_rng(seed)
    n = 150
    runs = [Run(d, p, d % 2 == 0) for d in (1, 2, 5, 30) for p in (1, 3)]
    close = np.round(100 * np.cumprod(1 + rng.normal(0, 0.02, n)), 1)
    track = np.concatenate([[np.nan], close[1:] / close[:-1] - 1]) * 3
    buy, sell = rng.random((n, len(runs))) < (0.05, 0.5)[seed % 2], rng.random((n, len(runs))) < 0.1
    one_day, day = np.zeros(n, bool), np.arange(n) - 70
    loop, trades = TimedMachine(runs, DEFAULT), TimedMachine(runs, DEFAULT)
    for s in (slice(0, 1), slice(1, 50), slice(50, 53), slice(53, n)):
        part = (close[s], track[s], day[s], buy[s], sell[s], one_day[s])
        want, got = super(TimedMachine, loop).advance(*part), trades.advance(*part)
        for field, values in want.items():
            np.testing.assert_array_equal(got[field], values, err_msg=field)
