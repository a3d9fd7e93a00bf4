"""Risk and return measures as aggregations over a position frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions import windows as W
from quotemill.functions.scalars import div
from quotemill.params import DEFAULT, Params

KEYS = ("symbol", "signal")
RETURN = "_r"


def with_returns(curve: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bar-to-bar return of an equity curve, for frames that do not carry it."""
    return curve.withColumn("daily_return", div(F.col("equity"), W.lag("equity", 1, keys)) - 1)


def used_returns(frame: DataFrame) -> DataFrame:
    """Adds the return where the equity is not zero, NULL elsewhere."""
    return frame.withColumn(RETURN, F.when(F.col("equity") != 0, F.col("daily_return")))


def _last(column: str) -> Column:
    return F.max_by(column, "date")


def sharpe(params: Params = DEFAULT, risk_free: float = 0.0) -> Column:
    """Annualised; 0 without variation, -100 for an account below zero."""
    std = F.stddev_samp(F.col(RETURN))
    ratio = div((F.avg(F.col(RETURN)) - risk_free) * math.sqrt(params.periods_per_year), std)
    return F.when(_last("equity") < 0, F.lit(-100.0)).when(std == 0, F.lit(0.0)).otherwise(ratio)


def sortino(params: Params = DEFAULT, risk_free: float = 0.0) -> Column:
    """Annualised over the root mean square of falls; 0 without falls."""
    fall = F.when(F.col(RETURN) < 0, F.col(RETURN)).when(F.col(RETURN).isNotNull(), F.lit(0.0))
    down = F.sqrt(F.avg(fall * fall))
    ratio = div((F.avg(F.col(RETURN)) - risk_free) * math.sqrt(params.periods_per_year), down)
    return F.when(down == 0, F.lit(0.0)).otherwise(ratio)


def cagr(params: Params = DEFAULT) -> Column:
    """Compound growth per year; NULL when the account changed sign."""
    growth = div(_last("equity"), F.min_by("equity", "date"))
    return F.pow(F.when(growth > 0, growth), div(F.lit(float(params.periods_per_year)), F.count(F.lit(1)))) - 1


def kelly() -> Column:
    """Mean return over its variance."""
    return div(F.avg(F.col(RETURN)), F.var_samp(F.col(RETURN)))


def trades() -> Column:
    return F.count_if("trade_out")


def positive_trades() -> Column:
    return F.count_if(F.col("trade_out") & (F.col("trade_pnl") > 0))


def pct_positive(when_none: float | None = None) -> Column:
    """Share of winning trades in percent; the result without trades is the caller's choice."""
    return F.coalesce(div(positive_trades() * 100.0, trades()), F.lit(when_none).cast("double"))


def average_win() -> Column:
    return F.avg(F.when(F.col("trade_out") & (F.col("trade_pnl") > 0), F.col("trade_pnl")))


def average_loss() -> Column:
    return F.avg(F.when(F.col("trade_out") & (F.col("trade_pnl") < 0), F.col("trade_pnl")))


def kelly_of(p: Column, win: Column, loss: Column) -> Column:
    """Kelly stake in percent from the win share and the mean win and loss."""
    return (p - div(1 - p, div(win, -loss))) * 100


def trade_kelly() -> Column:
    return kelly_of(div(positive_trades() * 1.0, trades()), average_win(), average_loss())


def measure(frame: DataFrame, keys: Sequence[str] = KEYS, **columns: Column) -> DataFrame:
    """Aggregate a position frame by key; all measures combine partially before the one shuffle."""
    return used_returns(frame).groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])


def summary(frame: DataFrame, keys: Sequence[str] = KEYS, params: Params = DEFAULT) -> DataFrame:
    """One row per run with every headline measure."""
    return measure(
        frame,
        keys,
        trades=trades(),
        positive_trades=positive_trades(),
        pct_positive=pct_positive(),
        avg_win_pct=average_win() * 100,
        avg_loss_pct=average_loss() * 100,
        last_equity=_last("equity"),
        max_dd=F.max("drawdown"),
        cagr=cagr(params),
        sharpe=sharpe(params),
        sortino=sortino(params),
        kelly_pct=trade_kelly(),
    )


def yearly(frame: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Result per calendar year, from the first to the last bar within the year."""
    first = F.min_by("equity", "date")
    return frame.groupBy(*keys, F.year("date").alias("year")).agg(
        (div(_last("equity") - first, first) * 100).alias("pnl_pct"),
        (F.max("drawdown") * 100).alias("drawdown_pct"),
        trades().alias("num_trades"),
        positive_trades().alias("positive_trades"),
    )


def treynor(
    frame: DataFrame,
    benchmark: DataFrame,
    keys: Sequence[str] = KEYS,
    risk_free: float = 0.0,
    params: Params = DEFAULT,
) -> DataFrame:
    """Mean excess return over beta; 0 where beta is undefined or zero.

    `benchmark` holds one `benchmark_return` per date. Beta is the covariance over shared dates divided
    by the variance of the whole benchmark; the mean takes every bar with a non-zero account.
    """
    excess = F.col("benchmark_return") - risk_free
    whole = Window.partitionBy("_series")
    side = benchmark.select("date", excess.alias("_bench"), F.lit("benchmark").alias("_series"))
    side = side.select("date", "_bench", F.var_samp("_bench").over(whole).alias("_variance"))
    joined = used_returns(frame).join(side, "date", "left")
    own = F.col("daily_return") - risk_free
    beta = F.coalesce(div(F.covar_samp(own, F.col("_bench")), F.max("_variance")), F.lit(0.0))
    return joined.groupBy(*keys).agg(
        beta.alias("beta"),
        F.when(beta == 0, F.lit(0.0)).otherwise(div(F.avg(F.col(RETURN)) - risk_free, beta)).alias("treynor"),
    )
