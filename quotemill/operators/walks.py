"""Many timed runs of one series, walked from trade to trade without a frame of bars by runs.

What a trade earns depends on its entry and exit bar alone, so everything a result table reports comes from tables that all
runs share: running sums of the bar returns, of their squares and of their losses, the log of the growth, and
its highest point, lowest point and deepest fall over stretches of 1, 2, 4, ... bars. The runs differ in
which bars they may enter: the thresholds of an axis only change the next allowed entry. All runs step together
from exit to next entry; a step costs a few lookups per run, however many bars it jumps.

Logs need every growth to be positive. A series that loses all in one bar, or that lacks a change, is left to the machines
(`Series.walkable`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from quotemill.operators.machines import Run
from quotemill.params import Params

#: The bar of no entry or exit.
NEVER = 1 << 40


class Series:
    """The shared tables of one symbol's bars and one side (long or short)."""

    def __init__(self, close: np.ndarray, track: np.ndarray, is_long: bool):
        n = len(close)
        self.n, self.close, self.is_long = n, close, is_long
        change = (track if is_long else -track).astype(float)
        if n:
            change[0] = 0.0  # no bar before it, so nothing is held on it
        self.walkable = bool(np.isfinite(change).all() and (change > -1).all() and np.isfinite(close).all() and (close != 0).all())
        if not self.walkable:
            return
        self.sums = np.vstack([np.cumsum(change), np.cumsum(change**2), np.cumsum(np.minimum(change, 0.0) ** 2)])
        self.log = np.cumsum(np.log1p(change))
        won = np.zeros(n, bool)
        won[1:] = close[1:] > close[:-1] if is_long else close[1:] < close[:-1]
        self.wins = np.cumsum(won)
        self.win_bars = np.append(np.flatnonzero(won), NEVER)
        # High, low and deepest fall of the log over 2^k points from each on.
        high = low = self.log
        fall = np.zeros(n)
        self.stretches = [(high, low, fall)]
        while 2 ** len(self.stretches) <= n:
            half = 2 ** (len(self.stretches) - 1)
            first, second = slice(0, len(high) - half), slice(half, None)
            fall = np.maximum(np.maximum(fall[first], fall[second]), high[first] - low[second])
            high, low = np.maximum(high[first], high[second]), np.minimum(low[first], low[second])
            self.stretches.append((high, low, fall))


def next_in(allowed: np.ndarray) -> np.ndarray:
    """For each row and run, the first row from there on that is allowed; `allowed` is rows x runs."""
    rows = len(allowed)
    table = np.where(allowed, np.arange(rows, dtype=np.int32)[:, None], np.int32(rows))
    table = np.minimum.accumulate(table[::-1], axis=0)[::-1]
    return np.vstack([table, np.full((1, allowed.shape[1]), rows, np.int32)])


class Flags:
    """The next bar, from any bar on, at which each run may act: only the bars of the base rule are listed."""

    def __init__(self, n: int, base: np.ndarray, allowed: np.ndarray | None, runs: int):
        """`allowed`: base bars x runs, or None if all runs act at every base bar."""
        self.bars = np.append(np.flatnonzero(base), NEVER)
        self.first = np.append(np.cumsum(base) - base, [base.sum()] * 2).astype(np.int64)
        self.table = None if allowed is None else next_in(allowed)
        self.limit = n + 1

    def after(self, bar: np.ndarray, run: np.ndarray) -> np.ndarray:
        at = self.first[np.minimum(bar, self.limit)]
        return self.bars[at if self.table is None else self.table[at, run]]


def walk(series: Series, runs: Sequence[Run], buys: Flags, sells: Flags, params: Params) -> dict[str, np.ndarray]:
    """What a `Tally` of the timed machine gives for the same runs."""
    count, n = len(runs), series.n
    days, profit = (np.array([getattr(r, f) for r in runs], np.int64) for f in ("days", "profit"))
    gained = np.zeros((3, count))  # returns, their squares, squares of losses
    level, peak, fall = np.zeros(count), np.zeros(count), np.zeros(count)
    trades, wins, losses = (np.zeros(count, np.int64) for _ in range(3))
    won, lost = np.zeros(count), np.zeros(count)
    state = {"trade_in": np.zeros(count, bool), "hold": np.zeros(count, bool), "trade_out": np.zeros(count, bool), "trade_pnl": np.zeros(count)}
    leverage = params.leverage if series.is_long else -params.leverage

    run, bar = np.arange(count), np.zeros(count, np.int64)
    while True:
        entry = buys.after(bar, run)
        here = entry < n
        run, entry = run[here], entry[here]
        if not len(run):
            break
        last_win = np.minimum(series.wins[entry] + profit[run] - 1, len(series.win_bars) - 1)
        leave = np.minimum(np.minimum(entry + days[run], sells.after(entry + 1, run)), series.win_bars[last_win])
        end = np.minimum(leave, n - 1)
        gained[:, run] += series.sums[:, end] - series.sums[:, entry]
        _fall_through(series, entry, end, run, level, peak, fall)
        level[run] += series.log[end] - series.log[entry]
        pnl = (series.close[end] - series.close[entry]) / series.close[entry] * leverage
        closed = leave < n
        trades[run] += closed
        for kind, hit, total in ((wins, closed & (pnl > 0), won), (losses, closed & (pnl < 0), lost)):
            kind[run] += hit
            total[run] += np.where(hit, pnl, 0.0)
        at_end = leave >= n - 1
        if at_end.any():
            who = run[at_end]
            state["trade_in"][who] = entry[at_end] == n - 1
            state["hold"][who] = entry[at_end] < n - 1
            state["trade_out"][who] = leave[at_end] == n - 1
            state["trade_pnl"][who] = np.where(entry[at_end] < n - 1, pnl[at_end], 0.0)
        run, bar = run[closed], leave[closed] + 1
    return _measures(n, gained, level, fall, trades, wins, losses, won, lost, params) | state


def _fall_through(series: Series, entry, end, run, level, peak, fall) -> None:
    """Carry each run's highest account and deepest fall, in logs, over the points from entry to end."""
    points, at = end - entry + 1, entry.copy()
    base = level[run] - series.log[entry]
    top, deep = peak[run], fall[run]
    for k in range(int(points.max()).bit_length()):
        part = np.flatnonzero(points >> k & 1)
        high, low, inside = series.stretches[k]
        i = at[part]
        deep[part] = np.maximum(np.maximum(deep[part], inside[i]), top[part] - base[part] - low[i])
        top[part] = np.maximum(top[part], base[part] + high[i])
        at[part] = i + (1 << k)
    peak[run], fall[run] = top, deep


def _measures(n, gained, level, fall, trades, wins, losses, won, lost, params: Params) -> dict[str, np.ndarray]:
    year, returns = params.periods_per_year, n - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = gained[0] / returns if returns > 0 else np.full(len(level), np.nan)
        spread = np.maximum(gained[1] - returns * mean**2, 0.0)
        std = np.sqrt(spread / (returns - 1)) if returns > 1 else np.full(len(level), np.nan)
        down = np.sqrt(gained[2] / returns) if returns > 0 else np.full(len(level), np.nan)
        return {
            "bars": np.full(len(level), n),
            "pnl": params.start_capital * np.exp(level),
            "max_dd": -np.expm1(-fall),
            "trades": trades,
            "positive_trades": wins,
            "avg_win": np.where(wins > 0, won / wins, np.nan),
            "avg_loss": np.where(losses > 0, lost / losses, np.nan),
            "cagr": np.expm1(level * year / n),
            "sharpe": np.where(std == 0, 0.0, np.sqrt(year) * mean / std),
            "sortino": np.where(down == 0, 0.0, np.sqrt(year) * mean / down),
        }
