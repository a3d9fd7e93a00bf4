"""Position state machines, advanced one bar at a time for many runs side by side.

A run is one choice of rule and limits. State is one small vector per quantity, a slot per run; bars
come in date order and in batches, so nothing but the last bar's state outlives a batch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from quotemill.params import Params


@dataclass(frozen=True)
class Run:
    """Limits of one run; days 0 leaves the open-ended machine without limits."""

    days: int
    profit: int
    is_long: bool = True


# The day of no entry; as a date it reads as missing.
NO_DAY = np.iinfo(np.int64).min

FIELDS = (
    "hold",
    "trade_in",
    "trade_out",
    "days_in_trade",
    "profitable_closes",
    "trade_entry",
    "entry_day",
    "trade_pnl",
    "equity",
)


class _Machine:
    def __init__(self, runs: Sequence[Run], params: Params):
        size = len(runs)
        self.days = np.array([r.days for r in runs])
        self.profit = np.array([r.profit for r in runs])
        self.is_long = np.array([r.is_long for r in runs])
        self.params = params
        self.previous_close = np.nan
        self.hold = np.zeros(size, bool)
        self.trade_in = np.zeros(size, bool)
        self.trade_out = np.zeros(size, bool)
        self.days_in_trade = np.zeros(size, np.int32)
        self.profitable_closes = np.zeros(size, np.int32)
        self.trade_entry = np.zeros(size)
        self.entry_day = np.full(size, NO_DAY)
        self.trade_pnl = np.zeros(size)
        self.equity = np.full(size, float(params.start_capital))

    def advance(self, close, track, day, buy, sell, one_day) -> dict[str, np.ndarray]:
        """Play one batch of bars; returns an array of bars x runs per field."""
        before = np.concatenate([[self.previous_close], close[:-1]])
        won = np.where(self.is_long, (close > before)[:, None], (close < before)[:, None])
        growth = 1 + np.where(self.is_long, track[:, None], -track[:, None])
        out = {f: np.empty((len(close), len(self.hold)), getattr(self, f).dtype) for f in FIELDS}
        for i in range(len(close)):
            self._bar(close[i], track[i], day[i], buy[i], sell[i], one_day[i], won[i], growth[i])
            for f in FIELDS:
                out[f][i] = getattr(self, f)
        self.previous_close = close[-1]
        return self._finish(out, close)

    def dump(self) -> list[tuple]:
        """Each run's place after the last bar, as plain values: the fields in order, then whether that bar bought."""
        was_buy = getattr(self, "was_buy", np.zeros(len(self.hold), bool))
        rows = zip(*[getattr(self, f).tolist() for f in FIELDS], was_buy.tolist(), strict=True)
        at = FIELDS.index("entry_day")
        return [tuple(None if i == at and v == NO_DAY else v for i, v in enumerate(row)) for row in rows]

    def load(self, rows: Sequence[tuple], previous_close: float | None, was_one_day: bool) -> None:
        """Go on from what `dump` gave, and the last bar's close and one-day flag."""
        columns = list(zip(*rows, strict=True))
        for f, values in zip(FIELDS, columns, strict=False):
            kept = [NO_DAY if v is None and f == "entry_day" else v for v in values]
            setattr(self, f, np.array(kept, getattr(self, f).dtype))
        self.previous_close = np.nan if previous_close is None else previous_close
        self.started, self.was_one_day, self.was_buy = True, was_one_day, np.array(columns[-1], bool)

    def _count(self, won) -> None:
        self.days_in_trade = np.where(self.hold, self.days_in_trade + 1, 0)
        self.profitable_closes = np.where(self.hold, self.profitable_closes + won, 0)

    def _finish(self, out, close):
        return out


class TimedMachine(_Machine):
    """Enters at the signal bar's close; leaves on a sell, after the days, or after enough won closes.

    The exit bar cannot open the next trade.
    """

    def _bar(self, close, track, day, buy, sell, one_day, won, growth):
        self.hold = (self.hold & ~self.trade_out) | self.trade_in
        self.trade_in = buy & ~self.hold
        self._count(won)
        self.trade_out = (
            (sell & self.hold) | (self.days_in_trade >= self.days) | (self.profitable_closes >= self.profit)
        )
        self.trade_entry = np.where(self.trade_in, close, np.where(self.hold, self.trade_entry, 0.0))
        self.entry_day = np.where(self.trade_in, day, np.where(self.hold, self.entry_day, NO_DAY))
        self.equity = np.where(self.hold, self.equity * growth, self.equity)

    def advance(self, close, track, day, buy, sell, one_day) -> dict[str, np.ndarray]:
        """As the bar loop does, but trade by trade: an exit is the first of the sell, the last day and the won close
        that fills the limit, all looked up at the entry; the columns follow from entries and exits."""
        if (self.days < 1).any() or (self.profit < 1).any():
            return super().advance(close, track, day, buy, sell, one_day)
        n, runs = buy.shape
        before = np.concatenate([[self.previous_close], close[:-1]])
        won = {True: close > before, False: close < before}
        run, entry, leave = self._trades(n, buy, sell, won)
        began, ended = entry >= 0, leave < n

        out = {f: np.zeros((n, runs), getattr(self, f).dtype) for f in FIELDS}
        step, first = np.zeros((n + 2, runs), np.int32), np.zeros((n + 1, runs), np.int64)
        step[entry + 1, run] += 1
        np.subtract.at(step, (np.minimum(leave, n) + 1, run), 1)
        first[entry + 1, run] = entry + 2
        hold = out["hold"] = np.cumsum(step, axis=0)[:n] > 0
        # Entry bar of each held bar; -1 is an entry in an earlier batch.
        at = np.where(hold, np.maximum.accumulate(first[:n], axis=0) - 2, 0)
        old = hold & (at < 0)
        out["trade_in"][entry[began], run[began]] = True
        out["trade_out"][leave[ended], run[ended]] = True
        wins = {side: np.cumsum(x) for side, x in won.items()}
        here = np.where(self.is_long, wins[True][:, None], wins[False][:, None])
        there = np.where(self.is_long, wins[True][at], wins[False][at])
        out["days_in_trade"][:] = np.where(old, np.arange(1, n + 1)[:, None] + self.days_in_trade, np.where(hold, np.arange(n)[:, None] - at, 0))
        out["profitable_closes"][:] = np.where(old, here + self.profitable_closes, np.where(hold, here - there, 0))
        fresh = out["trade_in"]
        out["trade_entry"] = np.where(fresh, close[:, None], np.where(old, self.trade_entry, np.where(hold, close[at], 0.0)))
        out["entry_day"] = np.where(fresh, day[:, None], np.where(old, self.entry_day, np.where(hold, day[at], NO_DAY)))
        growth = np.where(hold, 1 + np.where(self.is_long, track[:, None], -track[:, None]), 1.0)
        out["equity"] = np.multiply.accumulate(np.vstack([self.equity, growth]), axis=0)[1:]
        out = self._finish(out, close)
        for f in FIELDS:
            setattr(self, f, out[f][-1].copy())
        self.previous_close = close[-1]
        return out

    def _trades(self, n, buy, sell, won) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run, entry bar (-1: held already) and exit bar (n or more: held on) of every trade in this batch."""

        def ahead(flags):
            """The next bar, from each on, that has the flag; n if there is none."""
            where = np.where(flags, np.arange(n)[:, None], n)
            return np.vstack([np.minimum.accumulate(where[::-1], axis=0)[::-1], np.full((2, flags.shape[1]), n)]).T.tolist()

        places = {side: [*np.flatnonzero(x).tolist()] for side, x in won.items()}
        counts = {side: np.cumsum(x).tolist() for side, x in won.items()}
        next_buy, next_sell = ahead(buy), ahead(sell)
        held = (self.hold & ~self.trade_out) | self.trade_in
        found: list[tuple[int, int, int]] = []
        for k in range(len(held)):
            buys, sells, side = next_buy[k], next_sell[k], bool(self.is_long[k])
            days, profit, place, count = int(self.days[k]), int(self.profit[k]), places[side], counts[side]
            i = 0
            if held[k]:
                last = profit - int(self.profitable_closes[k]) - 1
                x = min(days - int(self.days_in_trade[k]) - 1, sells[0], place[last] if last < len(place) else n)
                found.append((k, -1, x))
                i = x + 1
            while i < n and (e := buys[i]) < n:
                last = count[e] + profit - 1
                x = min(e + days, sells[e + 1], place[last] if last < len(place) else n)
                found.append((k, e, x))
                i = x + 1
        run, entry, leave = np.array(found, np.int64).reshape(-1, 3).T
        return run, entry, leave

    def _finish(self, out, close):
        # Trade result against the entry close, leveraged, reversed for short runs.
        entry = np.where(out["hold"], out["trade_entry"], np.nan)
        gain = np.where(out["hold"], (close[:, None] - entry) / entry, 0.0)
        out["trade_pnl"] = gain * np.where(self.is_long, self.params.leverage, -self.params.leverage)
        return out


class OpenMachine(_Machine):
    """Leaves on a sell, on the stop, or after a lone one-day buy; results add up bar by bar.

    The first bar only sets the starting state. A one-day buy keeps a position across an exit, so a hold ends with the
    first bar that has an exit and no one-day buy. Holds are jumped over one by one: the next bar with a sell, with a full
    limit, and after a lone one-day buy are looked up; the running result is summed up to the nearest of them, in
    growing steps, to see whether the stop comes first.
    """

    #: Bars of a hold that are first tried against the stop.
    REACH = 64
    #: Above so many runs, a bar played for all of them at once costs less than their holds one by one.
    MANY = 20

    def __init__(self, runs, params):
        super().__init__(runs, params)
        self.started = False
        self.was_buy = np.zeros(len(runs), bool)
        self.was_one_day = False
        self.limited = self.days > 0

    def advance(self, close, track, day, buy, sell, one_day) -> dict[str, np.ndarray]:
        n, runs = buy.shape
        if runs > self.MANY:
            return super().advance(close, track, day, buy, sell, one_day)
        out = {f: np.zeros((n, runs), getattr(self, f).dtype) for f in FIELDS}
        out["entry_day"][:] = NO_DAY
        first = 0 if self.started else 1
        if first:
            for f in FIELDS:
                out[f][0] = getattr(self, f)
            self.started, self.was_buy, self.was_one_day = True, buy[0].copy(), bool(one_day[0])
        before = np.concatenate([[self.previous_close], close[:-1]])
        wins = {True: np.cumsum(close > before), False: np.cumsum(close < before)}
        free = np.flatnonzero(~one_day).tolist()
        for k in range(runs):
            self._play(k, first, close, track, day, buy[:, k], sell[:, k], one_day, wins[bool(self.is_long[k])], free, out)
        growth = np.where(out["hold"], 1 + track[:, None], 1.0)
        out["equity"] = np.multiply.accumulate(np.vstack([self.equity, growth]), axis=0)[1:]
        for f in FIELDS:
            setattr(self, f, out[f][-1].copy())
        self.previous_close, self.was_buy, self.was_one_day = close[-1], buy[-1].copy(), bool(one_day[-1])
        return out

    def _bar(self, close, track, day, buy, sell, one_day, won, growth):
        if self.started:
            was_hold = self.hold
            self.hold = (self.hold & ~self.trade_out) | self.trade_in | self.was_one_day
            self.trade_in = (buy | one_day) & ~self.hold
            self._count(won)
            opens = (self.trade_in | one_day) & (self.trade_entry == 0)
            self.trade_entry = np.where(opens, close, np.where(self.hold, self.trade_entry, 0.0))
            self.entry_day = np.where(opens, day, np.where(self.hold, self.entry_day, NO_DAY))
            self.trade_pnl = np.where(self.hold, self.trade_pnl + track, 0.0)
            self.trade_out = (
                (sell & self.hold)
                | (self.was_one_day & ~was_hold & ~self.was_buy)
                | (self.trade_pnl < -self.params.stop_loss)
                | (self.limited & ((self.days_in_trade >= self.days) | (self.profitable_closes >= self.profit)))
            )
            self.equity = np.where(self.hold, self.equity * (1 + track), self.equity)
        self.started, self.was_buy, self.was_one_day = True, buy, bool(one_day)

    def _play(self, k, first, close, track, day, buy, sell, one_day, wins, free, out) -> None:
        """All holds of one run, from bar `first` on."""
        n = len(close)
        entries = np.flatnonzero(buy | one_day).tolist()
        sells = np.flatnonzero(sell & ~one_day).tolist()
        column = {f: out[f][:, k] for f in FIELDS}
        limits = (int(self.days[k]), int(self.profit[k])) if self.limited[k] else None
        # What the bar before leaves behind: the entry that holds on, and days, won closes and result up to it.
        entry, entry_day = float(self.trade_entry[k]), int(self.entry_day[k])
        i = first
        if (self.hold[k] and not self.trade_out[k]) or self.trade_in[k] or self.was_one_day:
            lone = self.was_one_day and not self.hold[k] and not self.was_buy[k]
            carried = (int(self.days_in_trade[k]), int(self.profitable_closes[k]), float(self.trade_pnl[k]))
            i, entry, entry_day = self._hold(first, n, lone, carried, entry, entry_day, close, track, day, sell, one_day, wins, free, sells, limits, column)
        while i < n and (at := bisect_left(entries, i)) < len(entries):
            e = entries[at]
            # On the bar after an exit the old entry still stands, and no new one is noted.
            stale = e == i and i > first and column["hold"][i - 1] and entry != 0 or e == i == first and entry != 0
            entry, entry_day = (0.0, NO_DAY) if stale else (float(close[e]), int(day[e]))
            column["trade_in"][e] = True
            column["trade_entry"][e], column["entry_day"][e] = entry, entry_day
            if e + 1 >= n:
                return
            lone = bool(one_day[e]) and not buy[e]
            i, entry, entry_day = self._hold(e + 1, n, lone, (0, 0, 0.0), entry, entry_day, close, track, day, sell, one_day, wins, free, sells, limits, column)

    def _hold(self, b, n, lone, carried, entry, entry_day, close, track, day, sell, one_day, wins, free, sells, limits, column):
        """Fill one hold that starts with bar b; returns the bar after it, and the entry that its last bar shows."""
        if b >= n:
            return b, entry, entry_day
        days, ups, result = carried
        won_before = int(wins[b - 1]) if b else 0
        bound = [sells[at] if (at := bisect_left(sells, b)) < len(sells) else n]
        if lone and not one_day[b]:
            bound.append(b)
        if limits is not None:
            full = min(b + max(limits[0] - days - 1, 0), max(b, int(np.searchsorted(wins, won_before + limits[1] - ups))))
            bound.append(free[at] if (at := bisect_left(free, full)) < len(free) else n)
        end, stop = min(bound), -self.params.stop_loss
        # The running result, summed in order, in growing steps up to the nearest other exit.
        results, at, last, step = [], b, result, self.REACH
        while at < n and at <= end:
            upto = min(at + step, end + 1, n)
            part = np.cumsum(np.concatenate([[last], track[at:upto]]))[1:]
            results.append(part)
            below = np.flatnonzero((part < stop) & ~one_day[at:upto])
            if len(below):
                end = at + int(below[0])
                break
            at, last, step = upto, part[-1], step * 4
        stop_bar = min(end + 1, n)
        span = slice(b, stop_bar)
        pnl = np.concatenate(results)[: stop_bar - b]
        held = days + np.arange(1, stop_bar - b + 1)
        up = ups + wins[span] - won_before
        left = sell[span] | (pnl < stop)
        if lone:
            left[0] = True
        if limits is not None:
            left |= (held >= limits[0]) | (up >= limits[1])
        shown, shown_day = np.full(stop_bar - b, entry), np.full(stop_bar - b, entry_day)
        if entry == 0:
            # An entry that is still missing is noted at the first one-day buy of the hold.
            for x in np.flatnonzero(one_day[span]).tolist():
                shown[x:], shown_day[x:] = close[b + x], day[b + x]
                if close[b + x] != 0:
                    break
        column["hold"][span] = True
        column["trade_out"][span] = left
        column["days_in_trade"][span], column["profitable_closes"][span] = held, up
        column["trade_entry"][span], column["entry_day"][span] = shown, shown_day
        column["trade_pnl"][span] = pnl
        return stop_bar, float(shown[-1]), int(shown_day[-1])


def machine_for(runs: Sequence[Run], params: Params, open_ended: bool) -> _Machine:
    return (OpenMachine if open_ended else TimedMachine)(runs, params)


class Curve:
    """Running peak, drawdown and bar-to-bar return of the equity columns."""

    def __init__(self, size: int):
        self.peak = np.full(size, np.nan)
        self.last = np.full(size, np.nan)

    def push(self, equity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        peak = np.fmax.accumulate(np.vstack([self.peak, equity]), axis=0)[1:]
        before = np.vstack([self.last, equity[:-1]])
        with np.errstate(divide="ignore", invalid="ignore"):
            returns = np.where(before != 0, equity / before - 1, np.nan)
            drawdown = (peak - equity) / peak
        self.peak, self.last = peak[-1], equity[-1]
        return peak, drawdown, returns


class Tally:
    """Everything a result table reports about a run, in constant space."""

    def __init__(self, size: int, params: Params):
        self.params = params
        self.bars = 0
        self.first = np.full(size, np.nan)
        self.last = np.full(size, np.nan)
        self.max_dd = np.full(size, np.nan)
        self.n, self.mean, self.m2, self.down2 = (np.zeros(size) for _ in range(4))
        self.trades, self.wins, self.losses = (np.zeros(size, np.int64) for _ in range(3))
        self.won, self.lost = np.zeros(size), np.zeros(size)
        self.curve = Curve(size)
        self.state: dict[str, np.ndarray] = {}

    def push(self, out: dict[str, np.ndarray]) -> None:
        equity, exits, pnl = out["equity"], out["trade_out"], out["trade_pnl"]
        _, drawdown, returns = self.curve.push(equity)
        if self.bars == 0:
            self.first = equity[0].copy()
        self.bars += len(equity)
        self.last = equity[-1]
        self.max_dd = np.fmax(self.max_dd, np.fmax.reduce(drawdown, axis=0))
        self.trades += exits.sum(axis=0)
        win, loss = exits & (pnl > 0), exits & (pnl < 0)
        self.wins += win.sum(axis=0)
        self.losses += loss.sum(axis=0)
        self.won += np.where(win, pnl, 0.0).sum(axis=0)
        self.lost += np.where(loss, pnl, 0.0).sum(axis=0)
        self.state = {f: out[f][-1] for f in ("trade_in", "hold", "trade_out", "trade_pnl")}
        # Moments of the batch, then merged with what came before.
        used = ~np.isnan(returns) & (equity != 0)
        r = np.where(used, returns, 0.0)
        n = used.sum(axis=0)
        mean = r.sum(axis=0) / np.maximum(n, 1)
        m2 = np.where(used, (r - mean) ** 2, 0.0).sum(axis=0)
        total = self.n + n
        gap = mean - self.mean
        share = n / np.maximum(total, 1)
        self.mean = self.mean + gap * share
        self.m2 = self.m2 + m2 + gap**2 * self.n * share
        self.down2 += (np.minimum(r, 0.0) ** 2).sum(axis=0)
        self.n = total

    def result(self) -> dict[str, np.ndarray]:
        year = self.params.periods_per_year
        with np.errstate(divide="ignore", invalid="ignore"):
            std = np.where(self.n > 1, np.sqrt(self.m2 / (self.n - 1)), np.nan)
            mean = np.where(self.n > 0, self.mean, np.nan)
            down = np.sqrt(self.down2 / np.where(self.n > 0, self.n, np.nan))
            sharpe = np.where(std == 0, 0.0, np.sqrt(year) * mean / std)
            ratio = self.last / self.first
            growth = np.where(ratio > 0, ratio, np.nan) ** (year / self.bars) - 1
            return {
                "bars": np.full(len(self.n), self.bars),
                "pnl": self.last,
                "max_dd": self.max_dd,
                "trades": self.trades,
                "positive_trades": self.wins,
                "avg_win": np.where(self.wins > 0, self.won / self.wins, np.nan),
                "avg_loss": np.where(self.losses > 0, self.lost / self.losses, np.nan),
                "cagr": growth,
                "sharpe": np.where(self.last < 0, -100.0, sharpe),
                "sortino": np.where(down == 0, 0.0, np.sqrt(year) * mean / down),
                **self.state,
            }
