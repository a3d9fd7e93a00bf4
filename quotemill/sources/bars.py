"""Bar sources: tables, CSV files, foreign feeds, and raw records aggregated into bars."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.scalars import first_day_years_back
from quotemill.operators.relational import (
    alias_ticker,
    drop_columns,
    drop_null_close,
    keep_last_arrival,
    keep_sessions,
    normalize,
    plain_column,
)
from quotemill.params import DEFAULT, LEVEL_TICKERS, RATIO_TICKERS, Params
from quotemill.schema import BAR_COLUMNS, BAR_SCHEMA, PRICE_COLUMNS

# How one foreign index feed names its fields.
INDEX_FEED = {
    "date": "Trade Date",
    "open": "Open",
    "high": "High",
    "low": "Low",
    "close": "Index Value",
    "volume": "Total Market Value",
}

CONTEXT_TICKERS = tuple(dict.fromkeys([*LEVEL_TICKERS.values(), *RATIO_TICKERS.values()]))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA).parquet(path)


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars from CSV files with a header; columns are found by name, in any order and case.

    A file of one symbol may lack the symbol column; `symbol` then names it. Missing columns raise here,
    malformed rows, dates and numbers when they are read. Columns beyond the contract are ignored.
    """
    raw = spark.read.csv(path, header=True, mode="FAILFAST", inferSchema=False)
    raw = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    if symbol is not None:
        raw = raw.withColumn("symbol", F.lit(symbol))
    missing = [c for c in BAR_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    typed = {"symbol": F.col("symbol"), "date": F.to_date("date", "yyyy-MM-dd")}
    return raw.select(*[typed.get(c, F.col(c).cast("double")).alias(c) for c in BAR_COLUMNS])


def history(bars: DataFrame, years: int, today: dt.date | None = None) -> DataFrame:
    """Bars from January 1st `years` years back up to and including today."""
    day = F.lit(today) if today else F.current_date()
    return bars.filter(F.col("date").between(first_day_years_back(day, years), day))


def bulk_bars(bars: DataFrame, symbols: Sequence[str], years: int, today: dt.date | None = None) -> DataFrame:
    """History of many symbols; both predicates reach the table scan.

    A table may hold a future or currency under its feed name or its plain one. From here on it has the
    plain name, which rules, gates and boards use.
    """
    names = dict.fromkeys([*map(alias_ticker, symbols), *symbols])
    wanted = history(bars.filter(F.col("symbol").isin(*names)), years, today)
    return wanted.withColumn("symbol", plain_column(F.col("symbol")))


def bars_with_context(
    bars: DataFrame, symbol: str, years: int, today: dt.date | None = None, params: Params = DEFAULT
) -> DataFrame:
    """One symbol's history with the level, ratio and regime columns of its dates."""
    from quotemill.operators.context import attach_context, build_context

    panel = bulk_bars(bars, [symbol, *CONTEXT_TICKERS], years, today)
    own = panel.filter(F.col("symbol") == symbol)
    return drop_null_close(attach_context(own, build_context(panel), params=params))


def full_bars(
    bars: DataFrame,
    calendar: DataFrame,
    symbol: str,
    years: int,
    arrival: str | None = None,
    today: dt.date | None = None,
    params: Params = DEFAULT,
) -> DataFrame:
    """Load, attach context, normalise names, keep sessions, keep the last arrival per date."""
    loaded = keep_last_arrival(bars, arrival).drop(arrival) if arrival else bars
    loaded = normalize(drop_columns(bars_with_context(loaded, symbol, years, today, params), "adj_close"))
    return keep_sessions(loaded, calendar, params)


def from_feed(feed: DataFrame, symbol: Column, names: dict[str, str] = INDEX_FEED) -> DataFrame:
    """Map a feed's own column names to the bar contract."""
    return feed.select(
        symbol.alias("symbol"),
        F.to_date(F.col(f"`{names['date']}`")).alias("date"),
        *[F.col(f"`{names[c]}`").cast("double").alias(c) for c in PRICE_COLUMNS],
    ).select(*BAR_COLUMNS)


def order_key(*parts: tuple[Column, int]) -> Column:
    """One number that sorts like the parts in turn, each a whole number of at most that many digits.

    A fixed-width key lets the bar aggregation hash its groups; a struct key would make Spark sort all
    records by group first. A part with more digits than declared fails the cast instead of spilling
    into its neighbour. Parts must not be negative.
    """
    if sum(digits for _, digits in parts) > 38:
        raise ValueError("an order key holds 38 digits")
    key = None
    for part, digits in parts:
        number = part.cast(f"decimal({digits},0)")
        scale = F.lit(str(10**digits)).cast(f"decimal({digits + 1},0)")
        key = number if key is None else key * scale + number
    return key.cast("decimal(38,0)")


def build_bars(records: DataFrame, symbol: Column, time: Column, price: Column, size: Column, order: Column) -> DataFrame:
    """Daily bars from raw trades or events; `order` is unique per record, see `order_key`.

    Every aggregate combines partially before the shuffle on (symbol, date), so a symbol that holds a
    third of all records sends one partial row per task and date, not its records.
    """
    prices = records.select(
        symbol.alias("symbol"),
        F.to_date(time).alias("date"),
        price.alias("_price"),
        size.alias("_size"),
        order.alias("_order"),
    )
    return prices.groupBy("symbol", "date").agg(*bar_aggregates())


def bar_aggregates() -> list[Column]:
    """Open, high, low, close and volume of a group of `_price`, `_size`, `_order` rows."""
    return [
        F.min_by("_price", "_order").alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", "_order").alias("close"),
        F.sum("_size").alias("volume"),
    ]
