"""Table contracts and the naming of feed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
BAR_COLUMNS = tuple(BAR_SCHEMA.fieldNames())
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")

POSITION_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("buy", T.BooleanType()),
        T.StructField("sell", T.BooleanType()),
        T.StructField("one_day_buy", T.BooleanType()),
        T.StructField("hold", T.BooleanType()),
        T.StructField("trade_in", T.BooleanType()),
        T.StructField("trade_out", T.BooleanType()),
        T.StructField("days_in_trade", T.IntegerType()),
        T.StructField("profitable_closes", T.IntegerType()),
        T.StructField("trade_entry", T.DoubleType()),
        T.StructField("entry_date", T.DateType()),
        T.StructField("trade_pnl", T.DoubleType()),
        T.StructField("track_change", T.DoubleType()),
        T.StructField("equity", T.DoubleType()),
        T.StructField("running_max", T.DoubleType()),
        T.StructField("drawdown", T.DoubleType()),
        T.StructField("daily_return", T.DoubleType()),
    ]
)


# Display names that no spelling rule gives.
DISPLAY_EXCEPTIONS = {
    "pct_change": "%Change",
    "stoch_oscillator": "StochOscilator",
    "spy_bull": "SPYBull",
    "hold": "HoldLong",
    "trade_in": "LongTradeIn",
    "trade_out": "LongTradeOut",
    "equity": "RollingPnL",
    "trade_pnl": "TradePnL",
}
_ACRONYMS = ("rsi", "ema", "sma", "ibr", "cci", "er", "atr", "vfi", "macd", "bb")
_GAPS = ("close_", "ema20_", "sma50_", "sma20_", "atr20_")


def display_name(column: str) -> str:
    """Name a column carries in reports: words joined, acronyms in capitals, gap columns with a line."""
    if column in DISPLAY_EXCEPTIONS:
        return DISPLAY_EXCEPTIONS[column]
    words = [w.upper() if w.rstrip("0123456789") in _ACRONYMS else w.capitalize() for w in column.split("_")]
    return ("_" if column.startswith(_GAPS) else "").join(words)


def with_display_names(df: DataFrame) -> DataFrame:
    """Rename every column for a report."""
    return df.toDF(*[display_name(c) for c in df.columns])
