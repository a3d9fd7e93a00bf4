"""Boards: what fires on the latest bar, and scoreboards by rule and by symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions import windows as W
from quotemill.functions.scalars import div
from quotemill.operators.rules import Rule, rule_universe, with_rules
from quotemill.operators.sweeps import rule_trials, run_trials, with_kelly
from quotemill.params import DEFAULT, Params

# Symbols loaded for context only and left out of a board.
SCAN_EXCLUDED = ("^VIX", "RSP", "XLI", "XLU", "XLE", "XLF")
SYMBOL_BOARD_EXCLUDED = ("^VIX", "RSP")


def scan(
    bars: DataFrame, rules: Sequence[Rule], context: DataFrame | None = None, params: Params = DEFAULT
) -> DataFrame:
    """State of every eligible (symbol, rule) pair on the symbol's latest bar.

    Symbols no rule may trade are dropped at the scan of the bars, before anything is computed; pairs that
    are not eligible are left out before the grouped pass.
    """
    spark = bars.sparkSession
    symbols = sorted({s for r in rules for s in r.symbols})
    wide = with_rules(bars.filter(F.col("symbol").isin(*symbols)), rules, params, context)
    played = with_kelly(run_trials(wide, rule_trials(rules), params, eligible={r.name: set(r.symbols) for r in rules}))
    pairs = spark.createDataFrame(
        [(r.name, s, r.description, r.verdict) for r in rules for s in r.symbols],
        "signal string, symbol string, description string, verdict string",
    )
    eligible = played.join(F.broadcast(pairs), ["signal", "symbol"])
    return eligible.select(
        "symbol",
        "signal",
        F.col("trade_in").alias("buy_now"),
        F.col("hold").alias("holding"),
        F.col("trade_out").alias("sell_now"),
        "days",
        "profit",
        (F.col("trade_pnl") * 100).alias("trade_pnl_pct"),
        "kelly",
        "description",
        "verdict",
    )


def alerts(scanned: DataFrame) -> DataFrame:
    """One row: how many symbols buy and sell now under each rule, and the message that says so.

    Firing pairs are counted per rule first, so the lists never hold more than one entry per rule.
    """
    per_rule = (
        scanned.filter("buy_now OR sell_now")
        .groupBy("signal")
        .agg(F.count_if("buy_now").alias("buys"), F.count_if("sell_now").alias("sells"))
    )
    named = {
        f"{side}_signals": F.array_sort(
            F.collect_list(F.when(F.col(n) > 0, F.concat("signal", F.lit(" x"), F.col(n).cast("string"))))
        )
        for side, n in (("buy", "buys"), ("sell", "sells"))
    }
    lists = per_rule.agg(*[column.alias(name) for name, column in named.items()])
    quiet = (F.size("buy_signals") == 0) & (F.size("sell_signals") == 0)
    text = F.concat(
        F.lit("Buy signals: "),
        F.array_join("buy_signals", ", "),
        F.lit("; sell signals: "),
        F.array_join("sell_signals", ", "),
    )
    return lists.withColumn("message", F.when(quiet, F.lit("No signals today")).otherwise(text))


def rule_board(wide: DataFrame, rules: Sequence[Rule], params: Params = DEFAULT) -> DataFrame:
    """Every rule on every symbol given, with a mark whether the rule is meant for it."""
    played = run_trials(wide, rule_trials(rules), params)
    pairs = rule_universe(wide.sparkSession, rules).withColumn("_listed", F.lit(True))
    listed = played.join(F.broadcast(pairs), ["signal", "symbol"], "left")
    return listed.select(
        "symbol",
        "signal",
        F.coalesce("_listed", F.lit(False)).alias("subscribe"),
        (F.col("pnl") - params.start_capital).alias("pnl"),
        "max_dd",
        "trades",
        div(F.col("positive_trades") * 100.0, F.col("trades")).alias("pct_positive"),
        "days",
        "profit",
    )


def symbol_board(wide: DataFrame, rule: Rule, params: Params = DEFAULT) -> DataFrame:
    """One rule on every symbol."""
    played = run_trials(wide, rule_trials([rule]), params)
    return played.select("symbol", "pnl", "max_dd", "cagr", "sharpe", "sortino")


SNAPSHOT_LEVELS = ("spy", "qqq", "iwm", "soxx")
SNAPSHOT_COLUMNS = ("close", "ema8", "rsi2", "rsi5", "stoch", "rsi14_breadth", "volume_ema_diff")


def snapshot(frame: DataFrame) -> DataFrame:
    """Latest values per symbol: last-day change of the context tickers, price and indicators.

    `frame` carries the snapshot columns and the level columns, see `SNAPSHOT_*`.
    """
    moved = frame.select(
        "symbol",
        "date",
        *SNAPSHOT_COLUMNS,
        *[(W.pct_change(F.col(c)) * 100).alias(f"{c}_change_pct") for c in SNAPSHOT_LEVELS],
    )
    last = [F.max_by(c, "date").alias(c) for c in moved.columns if c not in ("symbol", "date")]
    return (
        moved.groupBy("symbol")
        .agg(F.max("date").alias("date"), *last)
        .withColumn("volume_ema_diff", F.col("volume_ema_diff") * 100)
        .withColumnRenamed("volume_ema_diff", "volume_ema_diff_pct")
    )
