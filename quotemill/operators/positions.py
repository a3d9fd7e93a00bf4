"""Positions: every rule of every symbol played bar by bar, and what follows from the result."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions import windows as W
from quotemill.functions.scalars import div
from quotemill.operators.machines import Curve, Run, machine_for
from quotemill.operators.rules import Rule
from quotemill.params import DEFAULT, Params
from quotemill.schema import POSITION_SCHEMA
from quotemill.session import date_sorted_groups, pieces


def track_change(params: Params = DEFAULT) -> Column:
    """Leveraged return a position earns: the bar's own, the proxy's, or their mean."""
    own = F.col("pct_change")
    if not params.use_proxy:
        return own
    proxy = W.pct_change(F.col(params.proxy_column)) * params.leverage
    return (proxy + own) / 2 if params.split_long else proxy


def is_open_ended(days: int) -> bool:
    """A rule without a day limit runs on the open-ended machine."""
    return days == 0


def split_by_machine(rules: Sequence[Rule]) -> dict[bool, list[Rule]]:
    groups: dict[bool, list[Rule]] = {}
    for rule in rules:
        groups.setdefault(is_open_ended(rule.days), []).append(rule)
    return groups


def positions(wide: DataFrame, rules: Sequence[Rule], params: Params = DEFAULT) -> DataFrame:
    """Position frame, one row per symbol, rule and bar, from the wide frame of `with_rules`.

    Rules of both machines are played in one pass, so the wide frame is computed once.
    """
    return _play(wide, split_by_machine(rules), params)


def play(wide: DataFrame, rules: Sequence[Rule], open_ended: bool, params: Params = DEFAULT) -> DataFrame:
    """Play rules on one machine: the timed one, or the open-ended one with or without limits."""
    return _play(wide, {open_ended: list(rules)}, params)


def kernel_input(wide: DataFrame, rules: Sequence[Rule], params: Params, *keep: str) -> DataFrame:
    """The columns a machine reads: prices, the tracked change, and a rule pair per run; and those to keep."""
    flags = [f"{side}_{r.name}" for r in rules for side in ("buy", "sell")]
    return wide.select("symbol", "date", "close", track_change(params).alias("track_change"), "one_day_buy", *flags, *keep)


def matrix(pdf: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    return pdf[list(names)].to_numpy(bool)


def day_number(pdf: pd.DataFrame) -> np.ndarray:
    return pd.to_datetime(pdf["date"]).to_numpy("datetime64[D]").astype(np.int64)


def _play(wide: DataFrame, groups: dict[bool, list[Rule]], params: Params) -> DataFrame:
    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        running = [
            (rules, machine_for([Run(r.days, r.profit, r.is_long) for r in rules], params, open_ended), Curve(len(rules)))
            for open_ended, rules in groups.items()
        ]
        for pdf in pieces(batches, params.bars_per_step):
            for rules, machine, curve in running:
                yield from _played(pdf, [r.name for r in rules], machine, curve)

    inputs = kernel_input(wide, [r for rules in groups.values() for r in rules], params)
    return date_sorted_groups(inputs, "symbol").applyInPandas(advance, POSITION_SCHEMA)


def _played(pdf: pd.DataFrame, names: Sequence[str], machine, curve: Curve) -> Iterator[pd.DataFrame]:
    """Advance one machine over a piece of bars; one frame of output rows per rule."""
    close, track = pdf["close"].to_numpy(float), pdf["track_change"].to_numpy(float)
    buy, sell = (matrix(pdf, [f"{side}_{n}" for n in names]) for side in ("buy", "sell"))
    one_day = pdf["one_day_buy"].to_numpy(bool)
    out = machine.advance(close, track, day_number(pdf), buy, sell, one_day)
    peak, drawdown, returns = curve.push(out["equity"])
    entered = out["entry_day"].astype("datetime64[D]")
    for k, name in enumerate(names):
        yield pd.DataFrame(
            {
                "symbol": pdf["symbol"].to_numpy(),
                "signal": name,
                "date": pdf["date"].to_numpy(),
                "close": close,
                "buy": buy[:, k],
                "sell": sell[:, k],
                "one_day_buy": one_day,
                "hold": out["hold"][:, k],
                "trade_in": out["trade_in"][:, k],
                "trade_out": out["trade_out"][:, k],
                "days_in_trade": out["days_in_trade"][:, k].astype(np.int32),
                "profitable_closes": out["profitable_closes"][:, k].astype(np.int32),
                "trade_entry": out["trade_entry"][:, k],
                "entry_date": pd.Series(entered[:, k]).dt.date,
                "trade_pnl": out["trade_pnl"][:, k],
                "track_change": track,
                "equity": out["equity"][:, k],
                "running_max": peak[:, k],
                "drawdown": drawdown[:, k],
                "daily_return": returns[:, k],
            }
        )


def with_drawdown(curve: DataFrame, keys: Sequence[str] = ("symbol", "signal")) -> DataFrame:
    """Running peak and drawdown of any equity curve."""
    peak = W.running_max(F.col("equity"), keys)
    return curve.withColumn("running_max", peak).withColumn(
        "drawdown", div(F.col("running_max") - F.col("equity"), F.col("running_max"))
    )


def trade_ledger(frame: DataFrame) -> DataFrame:
    """Closed trades: entry, exit, holding time and result."""
    return frame.filter("trade_out").select(
        "symbol",
        "signal",
        "entry_date",
        F.col("date").alias("exit_date"),
        "trade_entry",
        F.col("close").alias("trade_exit"),
        "days_in_trade",
        "trade_pnl",
    )


def bad_bars(bars: DataFrame) -> DataFrame:
    """Rows that cannot be traded on: no close, high below low, or more than one row per date."""
    copies = bars.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(F.col("close").isNull()).alias("null_closes"),
        F.count_if(F.col("high") < F.col("low")).alias("crossed"),
    )
    return copies.filter("copies > 1 OR null_closes > 0 OR crossed > 0")

