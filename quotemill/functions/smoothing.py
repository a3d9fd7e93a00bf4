"""Recurrences that reach back to a symbol's first bar: EMA, Wilder smoothing, RSI, ATR, MACD.

Bars arrive date-sorted in Arrow batches; only the last value of each recurrence is carried from one
batch to the next, so memory stays flat however long a series is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quotemill.session import date_sorted_groups


@dataclass(frozen=True)
class Smoothing:
    """One output column: `kind` is ema, rsi, atr or macd_hist."""

    name: str
    kind: str
    source: str
    periods: tuple[int, ...]

    @property
    def inputs(self) -> tuple[str, ...]:
        return ("high", "low", "close") if self.kind == "atr" else (self.source,)


def _number(x: float | None) -> float | None:
    """A plain double, or None for a missing one, as a state column holds it."""
    return None if x is None or np.isnan(x) else float(x)


class _Ewm:
    """y = a*x + (1-a)*y', seeded with the first value.

    A missing x repeats y but ages it: after k missing values y weighs (1-a)^(k+1) against a. The number of
    missing values since the last present one is part of the state.
    """

    def __init__(self, alpha: float):
        self.alpha = alpha
        self.last: float | None = None
        self.missed = 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        head = [] if self.last is None else [self.last, *[np.nan] * self.missed]
        y = pd.Series(np.concatenate([head, x])).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[len(head) :]
        present = np.flatnonzero(~np.isnan(x))
        if len(present):
            self.last, self.missed = float(y[-1]), len(x) - 1 - int(present[-1])
        elif self.last is not None:
            self.missed += len(x)
        return y

    def dump(self) -> tuple:
        return (None if self.last is None else float(self.last), self.missed)

    def load(self, last: float | None, missed: int) -> None:
        self.last, self.missed = last, missed


class _Ema:
    STATE = "seen long, last double, missed long"

    def __init__(self, spec: Smoothing):
        (n,) = spec.periods
        self.source, self.n, self.seen = spec.source, n, 0
        self.ewm = _Ewm(2.0 / (n + 1))

    def __call__(self, pdf: pd.DataFrame) -> np.ndarray:
        y = self.ewm(pdf[self.source].to_numpy(float))
        self.seen, y = _mask_head(y, self.seen, self.n - 1)
        return y

    def dump(self) -> tuple:
        return (self.seen, *self.ewm.dump())

    def load(self, seen, *ewm) -> None:
        self.seen = seen
        self.ewm.load(*ewm)


class _Rsi:
    """Starts at the first present value; a missing value moves neither average."""

    STATE = "seen long, previous double, up double, up_missed long, down double, down_missed long"

    def __init__(self, spec: Smoothing):
        (n,) = spec.periods
        self.source, self.n, self.seen = spec.source, n, 0
        self.up, self.down = _Ewm(1.0 / n), _Ewm(1.0 / n)
        self.previous = np.nan

    def __call__(self, pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[self.source].to_numpy(float)
        out = np.full(len(x), np.nan)
        start = 0
        if self.seen == 0:
            present = np.flatnonzero(~np.isnan(x))
            if not len(present):
                return out
            start = int(present[0])
        x = x[start:]
        change = np.diff(np.concatenate([[self.previous], x]))
        self.previous = x[-1]
        change = np.where(np.isnan(change), 0.0, change)
        up, down = self.up(np.maximum(change, 0.0)), self.down(np.maximum(-change, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.where(down == 0, 100.0, 100.0 - 100.0 / (1.0 + up / down))
        self.seen, out[start:] = _mask_head(y, self.seen, self.n - 1)
        return out

    def dump(self) -> tuple:
        return (self.seen, _number(self.previous), *self.up.dump(), *self.down.dump())

    def load(self, seen, previous, up, up_missed, down, down_missed) -> None:
        self.seen, self.previous = seen, np.nan if previous is None else previous
        self.up.load(up, up_missed)
        self.down.load(down, down_missed)


class _Atr:
    """Mean of the first n true ranges, then Wilder smoothing."""

    STATE = "head array<double>, previous double, last double, missed long"

    def __init__(self, spec: Smoothing):
        (self.n,) = spec.periods
        self.head: list[float] = []
        self.ewm = _Ewm(1.0 / self.n)
        self.previous = np.nan

    def __call__(self, pdf: pd.DataFrame) -> np.ndarray:
        high, low, close = (pdf[c].to_numpy(float) for c in ("high", "low", "close"))
        before = np.concatenate([[self.previous], close[:-1]])
        self.previous = close[-1]
        span = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
        out = np.full(len(span), np.nan)
        take = min(len(span), self.n - len(self.head)) if self.ewm.last is None else 0
        self.head.extend(span[:take])
        if take and len(self.head) == self.n:
            total = 0.0
            for value in self.head:
                total += value
            out[take - 1] = self.ewm.last = total / self.n
        if self.ewm.last is not None:
            out[take:] = self.ewm(span[take:])
        return out

    def dump(self) -> tuple:
        return ([_number(x) for x in self.head], _number(self.previous), *self.ewm.dump())

    def load(self, head, previous, *ewm) -> None:
        self.head = [np.nan if x is None else x for x in head]
        self.previous = np.nan if previous is None else previous
        self.ewm.load(*ewm)


class _MacdHist:
    """Fast minus slow EMA, less its own EMA, which starts at the first slow value."""

    STATE = (
        "seen long, signal_seen long, fast double, fast_missed long, slow double, slow_missed long, "
        "signal double, signal_missed long"
    )

    def __init__(self, spec: Smoothing):
        fast, self.slow_n, self.signal_n = spec.periods
        self.source, self.seen, self.signal_seen = spec.source, 0, 0
        self.fast, self.slow, self.signal = (_Ewm(2.0 / (n + 1)) for n in spec.periods)

    def __call__(self, pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[self.source].to_numpy(float)
        self.seen, line = _mask_head(self.fast(x) - self.slow(x), self.seen, self.slow_n - 1)
        out = np.full(len(x), np.nan)
        start = int(np.count_nonzero(np.isnan(line)))
        signal = self.signal(line[start:])
        self.signal_seen, signal = _mask_head(signal, self.signal_seen, self.signal_n - 1)
        out[start:] = line[start:] - signal
        return out

    def dump(self) -> tuple:
        return (self.seen, self.signal_seen, *self.fast.dump(), *self.slow.dump(), *self.signal.dump())

    def load(self, seen, signal_seen, fast, fast_missed, slow, slow_missed, signal, signal_missed) -> None:
        self.seen, self.signal_seen = seen, signal_seen
        self.fast.load(fast, fast_missed)
        self.slow.load(slow, slow_missed)
        self.signal.load(signal, signal_missed)


def _mask_head(y: np.ndarray, seen: int, hide: int) -> tuple[int, np.ndarray]:
    """Blank the outputs of a series' first `hide` rows, given `seen` rows in earlier batches."""
    y = y.copy()
    y[: max(0, hide - seen)] = np.nan
    return seen + len(y), y


_KINDS = {"ema": _Ema, "rsi": _Rsi, "atr": _Atr, "macd_hist": _MacdHist}


class Smoother:
    """The running state of several recurrences over one series."""

    def __init__(self, specs: Sequence[Smoothing]):
        self.steps = {s.name: _KINDS[s.kind](s) for s in specs}

    @staticmethod
    def state_schema(spec: Smoothing) -> str:
        """The typed fields that `dump` gives and `load` takes for one recurrence."""
        return _KINDS[spec.kind].STATE

    def push(self, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {name: step(pdf) for name, step in self.steps.items()}


def with_smoothings(df: DataFrame, specs: Sequence[Smoothing], key: str = "symbol") -> DataFrame:
    """Add the recurrences to a frame keyed by (key, date) in one pass per series."""
    if not specs:
        return df
    specs = list(specs)
    schema = T.StructType(df.schema.fields + [T.StructField(s.name, T.DoubleType()) for s in specs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        smoother = Smoother(specs)
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(**smoother.push(pdf))

    return date_sorted_groups(df, key).applyInPandas(run, schema)
