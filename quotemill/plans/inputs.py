"""Inputs of the registered queries, derived by Spark from the given tables.

Raw lines are aggregated into bars once per session and data folder and written to the shared work
folder; every query then reads that bar table, as a deployment would, instead of the raw lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.context import build_context, with_context_rsis
from quotemill.operators.relational import keep_sessions, plain_column
from quotemill.session import write_table
from quotemill.sources.bars import build_bars, order_key
from quotemill.sources.calendar import weekday_calendar
from quotemill.sources.sinks import clustered

# The feed's name of the ticker each brand stands for in the panel. Brand 15 is the volatility level.
BRAND_TICKERS = {
    1: "SPY", 2: "RSP", 3: "QQQ", 4: "SMH", 5: "XLF", 6: "XLE", 7: "XLU", 8: "XLI", 9: "IWM", 10: "TLT",
    11: "GLD", 12: "SOXX", 13: "UVXY", 14: "SQQQ", 15: "^VIX", 16: "AAPL", 17: "NVDA", 18: "XBI", 19: "FXI",
    20: "GDX", 21: "MSFT", 22: "INDA", 23: "CSCO", 24: "CL=F", 25: "NQ=F",
}
VIX_BASE, VIX_SCALE = 750.0, 10.0

_written: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_bars(spark: SparkSession, sf_dir: str, *symbols: str) -> DataFrame:
    """Bars from order lines: the price is the part's list price after discount and tax.

    Several symbol columns give the bars of each in one pass over the lines, told apart by a prefix of the
    symbol. The part table is small against the lines; Spark picks the join by its size at run time.
    """
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part").select("p_partkey", *symbols, "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")
    )
    symbol = symbols[0]
    if len(symbols) > 1:
        each = [F.concat(F.lit(f"{s}|"), F.col(s)) for s in symbols]
        lines, symbol = lines.withColumn("_symbol", F.explode(F.array(*each))), "_symbol"
    price = F.col("p_retailprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    # Order key and line number are not unique; the price, in its smallest unit, settles the rest.
    units = F.round(price * 100_000)
    order = order_key((F.col("l_orderkey"), 15), (F.col("l_linenumber"), 10), (units, 13))
    return build_bars(lines, F.col(symbol), F.col("l_shipdate"), price, F.col("l_quantity"), order)


def event_bars_order() -> Column:
    """Events in time order, ties by id."""
    return order_key((F.unix_micros(F.col("ts").cast("timestamp")), 17), (F.col("event_id"), 19))


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by brand under ticker names, the volatility brand rescaled to a level."""
    return as_tickers(line_bars(spark, sf_dir, "p_brand"))


def as_tickers(bars: DataFrame) -> DataFrame:
    number = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int")
    names = F.create_map(*[F.lit(v) for kv in BRAND_TICKERS.items() for v in kv])
    bars = bars.withColumn("symbol", F.coalesce(names[number], F.col("symbol")))
    level = F.col("symbol") == "^VIX"
    scaled = {
        c: F.when(level, (F.col(c) - VIX_BASE) / VIX_SCALE).otherwise(F.col(c)) for c in ("open", "high", "low", "close")
    }
    return bars.withColumns(scaled)


def _listing(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files that the shared tables are built from."""
    found = []
    for name in ("lineitem", "part"):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table built once per session and state of the data folder: new or changed files build it anew."""
    key = (spark.sparkContext.applicationId, _listing(spark, sf_dir), name)
    if key not in _written:
        _written[key] = write_table(build(), name)
    return spark.read.parquet(_written[key])


def _line_bars_by(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    """Bars by one symbol column, from a table that holds both and is built in one pass over the lines."""
    both = _once(spark, sf_dir, "line_bars", lambda: clustered(line_bars(spark, sf_dir, "p_type", "p_brand")))
    own = both.filter(F.col("symbol").startswith(f"{symbol}|"))
    return own.withColumn("symbol", F.substring_index("symbol", "|", -1))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by part type on every date that has lines, weekends included."""
    return _line_bars_by(spark, sf_dir, "p_type")


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by brand under the feed's ticker names."""
    return _once(spark, sf_dir, "brand_bars", lambda: clustered(as_tickers(_line_bars_by(spark, sf_dir, "p_brand"))))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "calendar", lambda: weekday_calendar(raw_bars(spark, sf_dir)))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session bars by part type."""
    return keep_sessions(raw_bars(spark, sf_dir), calendar(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session bars by brand under plain ticker names."""
    plain = raw_panel(spark, sf_dir).withColumn("symbol", plain_column(F.col("symbol")))
    return keep_sessions(plain, calendar(spark, sf_dir))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context per date with the RSIs of its ratios."""
    return _once(spark, sf_dir, "context", lambda: with_context_rsis(build_context(panel(spark, sf_dir))))

