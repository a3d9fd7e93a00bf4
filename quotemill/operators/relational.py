"""Relational preparation of bar tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.params import CURRENCIES, DEFAULT, FUTURES, Params


def normalize(df: DataFrame) -> DataFrame:
    """Lower-case snake names and a DATE-typed date column."""
    renamed = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    return renamed.withColumn("date", F.to_date("date"))


def capitalize(df: DataFrame) -> DataFrame:
    """Names with an upper first letter and the rest lower, as bar feeds are often displayed."""
    return df.toDF(*[c.capitalize() for c in df.columns])


def one_symbol(panel: DataFrame, symbol: str) -> DataFrame:
    return panel.filter(F.col("symbol") == symbol)


def alias_ticker(symbol: str) -> str:
    """Feed name of one ticker."""
    return symbol + "=F" if symbol in FUTURES else symbol + "=X" if symbol in CURRENCIES else symbol


def alias_column(symbol: Column) -> Column:
    """Feed name of a ticker column."""
    return (
        F.when(symbol.isin(*FUTURES), F.concat(symbol, F.lit("=F")))
        .when(symbol.isin(*CURRENCIES), F.concat(symbol, F.lit("=X")))
        .otherwise(symbol)
    )


def plain_column(symbol: Column) -> Column:
    """Plain name of a feed's ticker column; the inverse of `alias_column`."""
    feed = [alias_ticker(s) for s in (*FUTURES, *CURRENCIES)]
    return F.when(symbol.isin(*feed), F.regexp_replace(symbol, "=[FX]$", "")).otherwise(symbol)


def keep_sessions(bars: DataFrame, calendar: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Bars whose date is a session. Spark broadcasts the calendar if its stored size allows."""
    return bars.join(calendar.select("date"), "date", "left_semi").select(*bars.columns)


def keep_last_arrival(bars: DataFrame, arrival: str) -> DataFrame:
    """One row per (symbol, date), the latest by the arrival column, which orders the copies.

    max_by combines before the shuffle, so many copies of one bar never meet in a single task; taking
    it column by column keeps the aggregation hashed.
    """
    rest = [c for c in bars.columns if c not in ("symbol", "date")]
    return bars.groupBy("symbol", "date").agg(*[F.max_by(c, arrival).alias(c) for c in rest]).select(*bars.columns)


def drop_null_close(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col("close").isNotNull())


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop the named columns where present."""
    return df.drop(*names)


def exclude_symbols(bars: DataFrame, symbols: Sequence[str]) -> DataFrame:
    return bars.filter(~F.col("symbol").isin(*symbols))


def append_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_and_last(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str = "date") -> DataFrame:
    """First and last values per group in one hashed aggregation, without sorting the group."""
    first = [F.min_by(c, order).alias(f"first_{c}") for c in columns]
    last = [F.max_by(c, order).alias(f"last_{c}") for c in columns]
    return df.groupBy(*keys).agg(*first, *last)
