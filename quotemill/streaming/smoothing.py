"""Streaming recurrences: EMA, RSI, ATR and MACD of bars as they close."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quotemill.functions.smoothing import Smoothing
from quotemill.streaming.stateful import Recurrences, carry


def stream_smoothings(bars: DataFrame, specs: Sequence[Smoothing], arrival: str | None = None) -> DataFrame:
    """The batch recurrences over a bar stream; each symbol's running values are its state."""
    schema = T.StructType(bars.schema.fields + [T.StructField(s.name, T.DoubleType()) for s in specs])
    return carry(bars, Recurrences(specs, arrival), schema)
