"""Cross-symbol context: one row per date with level, ratio and regime columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.scalars import div, flag
from quotemill.functions.smoothing import Smoothing, with_smoothings
from quotemill.functions.windows import rolling_mean
from quotemill.params import CONTEXT_RSI_PERIODS, DEFAULT, LEVEL_TICKERS, RATIO_TICKERS, Params

LEVELS = tuple(LEVEL_TICKERS)
RATIOS = tuple(RATIO_TICKERS)


def rsi_name(period: int, ratio: str) -> str:
    return f"rsi{period}_{ratio}"


CONTEXT_RSIS = {
    rsi_name(n, ratio): Smoothing(rsi_name(n, ratio), "rsi", "value", (n,))
    for ratio, periods in CONTEXT_RSI_PERIODS.items()
    for n in periods
}
CONTEXT_COLUMNS = (*LEVELS, *RATIOS, "spy_bull", *CONTEXT_RSIS)


def pivot_closes(panel: DataFrame) -> DataFrame:
    """One row per date, one column per context ticker. The ticker list is fixed, so no extra pass."""
    tickers = tuple(dict.fromkeys([*LEVEL_TICKERS.values(), *RATIO_TICKERS.values()]))
    wanted = panel.filter(F.col("symbol").isin(*tickers)).select("symbol", "date", "close")
    return wanted.groupBy("date").pivot("symbol", list(tickers)).agg(F.first("close"))


def levels_and_ratios(panel: DataFrame) -> DataFrame:
    closes = pivot_closes(panel)
    spy = F.col("SPY")
    return closes.select(
        "date",
        *[F.col(f"`{t}`").alias(c) for c, t in LEVEL_TICKERS.items()],
        *[div(F.col(f"`{t}`"), spy).alias(c) for c, t in RATIO_TICKERS.items()],
    )


def with_regime(context: DataFrame) -> DataFrame:
    """+1 while the 50-session mean of SPY is above the 200-session mean, -1 otherwise."""
    fast, slow = (rolling_mean(F.col("spy"), n, keys=("_series",)) for n in (50, 200))
    return context.withColumn("_series", F.lit("spy")).withColumn("spy_bull", flag(fast > slow)).drop("_series")


def build_context(panel: DataFrame) -> DataFrame:
    """Levels, ratios and regime per date. The frame has one row per session and stays that small."""
    return with_regime(levels_and_ratios(panel))


def context_rsis(context: DataFrame, names: Sequence[str] = tuple(CONTEXT_RSIS)) -> DataFrame:
    """RSIs of the ratio series, computed once per date rather than once per symbol.

    The ratios become rows so that each series is its own group, then columns again.
    """
    wanted = [n for n in CONTEXT_RSIS if n in names]
    ratios = [r for r in CONTEXT_RSI_PERIODS if any(rsi_name(n, r) in wanted for n in CONTEXT_RSI_PERIODS[r])]
    periods = sorted({n for r in ratios for n in CONTEXT_RSI_PERIODS[r] if rsi_name(n, r) in wanted})
    series = context.select("date", *ratios).unpivot("date", ratios, "series", "value")
    smooth = with_smoothings(series, [Smoothing(f"rsi{n}", "rsi", "value", (n,)) for n in periods], key="series")
    rows = smooth.groupBy("date").pivot("series", ratios).agg(*[F.first(f"rsi{n}").alias(f"rsi{n}") for n in periods])
    taken = [
        F.col(f"{r}_rsi{n}" if len(periods) > 1 else r).alias(rsi_name(n, r))
        for r in ratios
        for n in periods
        if rsi_name(n, r) in wanted
    ]
    return rows.select("date", *taken)


def with_context_rsis(context: DataFrame) -> DataFrame:
    return context.join(context_rsis(context), "date", "left")


def attach_context(
    bars: DataFrame, context: DataFrame, columns: Sequence[str] | None = None, params: Params = DEFAULT
) -> DataFrame:
    """Left join by date of the wanted context columns. A stored context is broadcast by Spark if its size allows."""
    wanted = [c for c in context.columns if c != "date" and (columns is None or c in columns)]
    return bars.join(context.select("date", *wanted), "date", "left").select(*bars.columns, *wanted)
