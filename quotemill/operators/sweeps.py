"""Parameter sweeps: many runs of one rule per symbol, reduced to one result row per run.

Bars are shipped once per symbol, never once per run. Timed runs step from trade to trade over tables that all runs of
the symbol share (`walks`), so a symbol's whole grid is one small task. Runs of the open-ended machine are
dealt into blocks; the block number is then part of the grouping key, and one symbol's grid spreads over its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.functions.scalars import div
from quotemill.operators.machines import Run, Tally, machine_for
from quotemill.operators.metrics import kelly_of
from quotemill.operators.positions import day_number, is_open_ended, track_change
from quotemill.operators.rules import Rule
from quotemill.operators.walks import Flags, Series, walk
from quotemill.params import DEFAULT, NO_VOLUME_SYMBOLS, Params
from quotemill.session import date_sorted_groups, pieces


@dataclass(frozen=True)
class Trial:
    """One run of a rule: its limits and, for threshold sweeps, one extra condition."""

    signal: str
    days: int
    profit: int
    is_long: bool = True
    side: str | None = None
    column: str | None = None
    condition: str | None = None
    value: float | None = None


@dataclass(frozen=True)
class Axis:
    """Threshold values of one indicator column, with the gates that switch it on."""

    column: str
    low: float
    high: float
    step: float
    block: str = "other"
    first_year: int | None = None
    needs_volume: bool = False

    def values(self) -> list[float]:
        """Low to high inclusive; computed from the index so that steps do not drift."""
        count = math.floor((self.high - self.low) / self.step + 1e-9)
        return [round(self.low + i * self.step, 10) for i in range(count + 1)]


TRIAL_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("indicator", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("days", T.LongType()),
        T.StructField("profit", T.LongType()),
        T.StructField("bars", T.LongType()),
        T.StructField("pnl", T.DoubleType()),
        T.StructField("max_dd", T.DoubleType()),
        T.StructField("trades", T.LongType()),
        T.StructField("positive_trades", T.LongType()),
        T.StructField("avg_win", T.DoubleType()),
        T.StructField("avg_loss", T.DoubleType()),
        T.StructField("cagr", T.DoubleType()),
        T.StructField("sharpe", T.DoubleType()),
        T.StructField("sortino", T.DoubleType()),
        T.StructField("trade_in", T.BooleanType()),
        T.StructField("hold", T.BooleanType()),
        T.StructField("trade_out", T.BooleanType()),
        T.StructField("trade_pnl", T.DoubleType()),
    ]
)


def day_grid(rule: Rule, max_days: int = 10) -> list[Trial]:
    """Every holding limit up to `max_days` with every profit count up to it."""
    return [
        Trial(rule.name, d, p, rule.is_long) for d in range(1, max_days + 1) for p in range(1, d + 1)
    ]


def threshold_grid(rule: Rule, axes: Sequence[Axis], side: str = "buy", condition: str = "both") -> list[Trial]:
    """One trial per axis value and direction: the column at most (less) or at least (more) the value."""
    directions = ("more", "less") if condition == "both" else (condition,)
    return [
        Trial(rule.name, rule.days, rule.profit, rule.is_long, side, a.column, d, v)
        for a in axes
        for v in a.values()
        for d in directions
    ]


def rule_trials(rules: Sequence[Rule]) -> list[Trial]:
    """Each rule as it stands."""
    return [Trial(r.name, r.days, r.profit, r.is_long) for r in rules]


# Threshold axes of the wide search, in two blocks.
def _axes(block: str, low: float, high: float, step: float, columns: str, **gates) -> list[Axis]:
    return [Axis(c, low, high, step, block, **gates) for c in columns.split()]


BREADTH_AXES = [
    *_axes("breadth", 10, 90, 10, "rsi2_bond_breadth rsi5_bond_breadth rsi14_bond_breadth"),
    *_axes("breadth", 10, 90, 10, "rsi14_financials_breadth rsi14_energy_breadth"),
    *_axes("breadth", 10, 90, 10, "rsi14_utilities_breadth rsi14_industrials_breadth"),
    *_axes("breadth", 10, 90, 10, "rsi5_financials_breadth rsi5_energy_breadth"),
    *_axes("breadth", 10, 90, 10, "rsi5_utilities_breadth rsi5_industrials_breadth"),
    *_axes("breadth", 10, 90, 10, "rsi2_gold_breadth rsi5_gold_breadth rsi14_gold_breadth"),
    *_axes("breadth", 20, 80, 10, "rsi14_breadth rsi5_breadth", first_year=2003),
    *_axes("breadth", 10, 90, 10, "rsi2_breadth", first_year=2003),
    *_axes("breadth", 20, 80, 10, "rsi14_risk_breadth rsi5_risk_breadth rsi5_semis_breadth rsi14_semis_breadth"),
    *_axes("breadth", 10, 90, 10, "rsi2_risk_breadth rsi2_semis_breadth"),
]
OTHER_AXES = [
    *_axes("other", 0, 0, 1, "lower_closes2 lower_closes3 higher_closes2 higher_closes3"),
    *_axes("other", -0.06, 0.06, 0.01, "pct_change"),
    *_axes("other", 0, 0, 1, "rsi_buy"),
    *_axes("other", -10, 10, 1, "close_ema8"),
    *_axes("other", 0, 0, 1, "ema8_cross_up ema8_cross_down atr20_atr50"),
    *_axes("other", -2, 2, 0.5, "change_velocity"),
    *_axes("other", 0, 0, 1, "ema20_ema100 lowest_close2 lowest_close3 highest_close2 highest_close3"),
    *_axes("other", 0, 0, 1, "sma50_sma200 sma20_sma50 close_sma200 close_sma50 close_sma20"),
    *_axes("other", -8, 8, 2, "vfi80 vfi40 vfi10 vfi20", needs_volume=True),
    *_axes("other", 10, 50, 5, "vix"),
    *_axes("other", 10, 90, 10, "stoch"),
    *_axes("other", 20, 90, 10, "rsi14 rsi5"),
    *_axes("other", 10, 50, 5, "rsi2"),
    *_axes("other", 0.1, 0.9, 0.1, "er"),
    *_axes("other", -150, 150, 50, "cci"),
    *_axes("other", 0.1, 0.9, 0.1, "ibr ibr2 ibr3"),
    *_axes("other", -12, 12, 2, "value_charts"),
    *_axes("other", 0, 0, 1, "macd_hist stoch_oscillator spy_bull"),
]
# Axes that differ when the search widens the sell rule.
SELL_OVERRIDES = {"rsi_buy": Axis("rsi_sell", 0, 0, 1), "rsi2": Axis("rsi2", 50, 99, 5)}


def search_axes(side: str = "buy", check_breadth: bool = True, check_both: bool = True) -> list[Axis]:
    """Axes of the wide search under its two switches."""
    axes = BREADTH_AXES if check_breadth else []
    if check_both or not check_breadth:
        other = [SELL_OVERRIDES.get(a.column, a) for a in OTHER_AXES] if side == "sell" else OTHER_AXES
        axes = [*axes, *other]
    # The upper end of the one axis its step does not divide is rounded up to a whole step.
    return [replace(a, high=a.low + math.ceil((a.high - a.low) / a.step - 1e-9) * a.step) for a in axes]


def trial_columns(trials: Sequence[Trial]) -> list[str]:
    return sorted({t.column for t in trials if t.column})


def run_trials(
    wide: DataFrame,
    trials: Sequence[Trial],
    params: Params = DEFAULT,
    axes: Sequence[Axis] = (),
    eligible: Mapping[str, Collection[str]] | None = None,
) -> DataFrame:
    """Result row per symbol and trial, from a `with_rules` frame that carries the trial columns.

    `eligible` names the symbols of each signal; other pairs are neither shipped nor played.
    """
    blocks = _blocks(trials, params.runs_per_task)
    gates = {a.column: a for a in axes}

    def due(number: int) -> Column:
        """A block's number, on the symbols that any of its trials may play."""
        if eligible is None:
            return F.lit(number)
        symbols = sorted({s for t in blocks[number] for s in eligible[t.signal]})
        return F.when(F.col("symbol").isin(*symbols), F.lit(number))

    users: dict[str, list[int]] = {}
    for number, block in enumerate(blocks):
        for t in block:
            for column in (f"buy_{t.signal}", f"sell_{t.signal}", t.column):
                if column and number not in users.setdefault(column, []):
                    users[column].append(number)

    block_id = F.col("_block")
    base = wide.withColumn("_track", track_change(params))
    if len(blocks) == 1:
        base = base.withColumn("_block", due(0)).where(block_id.isNotNull())
    else:
        base = base.withColumn("_block", F.explode(F.array_compact(F.array(*[due(i) for i in range(len(blocks))]))))
    # A column travels only with the blocks that read it.
    shipped = base.select(
        "symbol",
        "date",
        "_block",
        F.col("close").alias("_close"),
        "_track",
        "one_day_buy",
        *[
            F.when(block_id.isin(*numbers), F.col(c)).alias(c) if len(numbers) < len(blocks) else F.col(c)
            for c, numbers in users.items()
        ],
    )

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A series is bounded by the calendar.
        bars = pd.concat(list(batches), ignore_index=True)
        symbol, first_year = bars["symbol"].iloc[0], pd.Timestamp(bars["date"].iloc[0]).year
        block = [
            t
            for t in blocks[int(bars["_block"].iloc[0])]
            if _open(gates.get(t.column), symbol, first_year) and (eligible is None or symbol in eligible[t.signal])
        ]
        for part, result in _results(bars, block, params):
            yield pd.DataFrame(
                {
                    "symbol": symbol,
                    "signal": [t.signal for t in part],
                    "side": [t.side for t in part],
                    "indicator": [t.column for t in part],
                    "condition": [t.condition for t in part],
                    "value": [t.value for t in part],
                    "days": [t.days for t in part],
                    "profit": [t.profit for t in part],
                    **result,
                }
            )

    return date_sorted_groups(shipped, "symbol", "_block").applyInPandas(play, TRIAL_SCHEMA)


def _results(bars: pd.DataFrame, block: Sequence[Trial], params: Params) -> Iterator[tuple[list[Trial], dict]]:
    """Trials of one symbol with their result columns, a bounded number of runs at a time."""
    close, track = bars["_close"].to_numpy(float), bars["_track"].to_numpy(float)
    series = {side: Series(close, track, side) for side in {t.is_long for t in block}}
    walked: dict[tuple, list[Trial]] = {}
    played = []
    for t in block:
        if t.days > 0 and t.profit > 0 and series[t.is_long].walkable:
            walked.setdefault((t.signal, t.is_long), []).append(t)
        else:
            played.append(t)
    for (signal, is_long), trials in walked.items():
        base = {side: bars[f"{side}_{signal}"].to_numpy(bool) for side in ("buy", "sell")}
        for i in range(0, len(trials), params.runs_per_walk):
            part = trials[i : i + params.runs_per_walk]
            runs = [Run(t.days, t.profit, t.is_long) for t in part]
            yield part, walk(series[is_long], runs, *_flags(bars, base, part), params)
    for open_ended in (False, True):
        rest = [t for t in played if is_open_ended(t.days) == open_ended]
        for i in range(0, len(rest), params.runs_per_task):
            yield _machine_results(bars, rest[i : i + params.runs_per_task], open_ended, params)


def _machine_results(bars: pd.DataFrame, part: list[Trial], open_ended: bool, params: Params) -> tuple[list[Trial], dict]:
    """The same by a machine, in pieces of bars."""
    machine, tally = machine_for([Run(t.days, t.profit, t.is_long) for t in part], params, open_ended), Tally(len(part), params)
    for pdf in pieces([bars], params.bars_per_step):
        buy, sell = _conditions(pdf, part)
        close, track = pdf["_close"].to_numpy(float), pdf["_track"].to_numpy(float)
        tally.push(machine.advance(close, track, day_number(pdf), buy, sell, pdf["one_day_buy"].to_numpy(bool)))
    return part, tally.result()


def _flags(bars: pd.DataFrame, base: Mapping[str, np.ndarray], part: Sequence[Trial]) -> tuple[Flags, Flags]:
    """Where each trial may enter and must leave."""
    n, count = len(bars), len(part)
    met: dict[str, np.ndarray] = {}
    for side in ("buy", "sell"):
        at = [(k, t) for k, t in enumerate(part) if t.column and (t.side == "sell") == (side == "sell")]
        if not at:
            continue
        # A narrowed buy lists the rule's own bars only; a widened sell may be any bar.
        rows = np.flatnonzero(base["buy"]) if side == "buy" else np.arange(n)
        own = np.ones(len(rows), bool) if side == "buy" else base["sell"]
        table = np.repeat(own[:, None], count, axis=1)
        values = {c: bars[c].to_numpy(float)[rows] for c in {t.column for _, t in at}}
        for k, t in at:
            hit = values[t.column] >= t.value if t.condition == "more" else values[t.column] <= t.value
            table[:, k] = own & hit if side == "buy" else own | hit
        met[side] = table
    buys = Flags(n, base["buy"], met.get("buy"), count)
    sells = Flags(n, np.ones(n, bool) if "sell" in met else base["sell"], met.get("sell"), count)
    return buys, sells


def _blocks(trials: Sequence[Trial], size: int) -> list[list[Trial]]:
    """All timed trials as one block; open-ended ones in blocks of `size`, neighbours sharing a column."""
    key = lambda t: (t.signal, t.column or "", t.condition or "", t.value or 0.0)
    timed = sorted((t for t in trials if not is_open_ended(t.days)), key=key)
    rest = sorted((t for t in trials if is_open_ended(t.days)), key=key)
    return [b for b in (timed, *[rest[i : i + size] for i in range(0, len(rest), size)]) if b]


def _open(axis: Axis | None, symbol: str, first_year: int) -> bool:
    """Whether the gates of an axis let this symbol's series through."""
    if axis is None:
        return True
    if axis.first_year is not None and first_year < axis.first_year:
        return False
    return not (axis.needs_volume and symbol in NO_VOLUME_SYMBOLS)


def _conditions(pdf: pd.DataFrame, block: Sequence[Trial]) -> tuple[np.ndarray, np.ndarray]:
    """Buy and sell flags, bars x trials, with each trial's extra condition applied."""
    flags = {c: pdf[c].to_numpy(bool) for t in block for c in (f"buy_{t.signal}", f"sell_{t.signal}")}
    values = {t.column: pdf[t.column].to_numpy(float) for t in block if t.column}
    buy = np.empty((len(pdf), len(block)), bool)
    sell = np.empty_like(buy)
    for k, t in enumerate(block):
        buy[:, k], sell[:, k] = flags[f"buy_{t.signal}"], flags[f"sell_{t.signal}"]
        if t.column:
            x = values[t.column]
            met = x >= t.value if t.condition == "more" else x <= t.value
            if t.side == "sell":
                sell[:, k] |= met
            else:
                buy[:, k] &= met
    return buy, sell


def rank_key() -> list[Column]:
    """Best ratio first; ties fall back to the trial itself so that the order is total."""
    ties = [F.col(c).asc_nulls_first() for c in ("side", "indicator", "condition", "value", "days", "profit")]
    return [F.round("sharpe", 9).desc_nulls_last(), *ties]


def top_per(results: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of every group."""
    order = Window.partitionBy(*keys).orderBy(*rank_key())
    return results.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def top(results: DataFrame, k: int) -> DataFrame:
    """The k best rows overall; each task keeps its own k before the merge."""
    return results.orderBy(*rank_key(), "symbol").limit(k)


def search(wide: DataFrame, rule: Rule, params: Params = DEFAULT, side: str = "buy", **switches) -> DataFrame:
    """Wide threshold search: every axis in one job, the three best trials of each axis kept."""
    axes = search_axes(side, **switches)
    results = run_trials(wide, threshold_grid(rule, axes, side), params, axes)
    return top_per(results, 3, "symbol", "side", "indicator")


def search_columns(side: str = "buy", **switches) -> list[str]:
    return sorted({a.column for a in search_axes(side, **switches)})


def report(results: DataFrame) -> DataFrame:
    """Result columns of a sweep; measures stay numeric.

    A threshold trial without trades shows 0 percent winners, a holding trial without trades none.
    """
    share = div(F.col("positive_trades") * 100.0, F.col("trades"))
    return results.select(
        "symbol",
        "signal",
        "side",
        "indicator",
        "condition",
        "value",
        "days",
        "profit",
        "pnl",
        "max_dd",
        "trades",
        F.when(F.col("side").isNull() | (F.col("trades") > 0), share).otherwise(F.lit(0.0)).alias("pct_positive"),
        "cagr",
        "sharpe",
        "sortino",
    )


def with_kelly(results: DataFrame) -> DataFrame:
    share = div(F.col("positive_trades") * 1.0, F.col("trades"))
    return results.withColumn("kelly", kelly_of(share, F.col("avg_win"), F.col("avg_loss")))
