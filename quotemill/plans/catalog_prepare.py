"""Registered queries: sources, relational preparation, context, window and scalar functions."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import scalars as S
from quotemill.functions import windows as W
from quotemill.functions.smoothing import Smoothing, with_smoothings
from quotemill.operators import relational as R
from quotemill.operators.context import LEVELS, RATIOS, levels_and_ratios, with_regime
from quotemill.operators.positions import bad_bars
from quotemill.operators.sweeps import Axis
from quotemill.params import CURRENCIES, FUTURES
from quotemill.plans import inputs as I
from quotemill.plans.oracle_parts import flag, lag, over, r6, roll, six, sql
from quotemill.plans.registry import add
from quotemill.session import work_folder
from quotemill.sources import bars as B
from quotemill.sources.sinks import load_bars, loaded_bars, write_bad_dates, write_bars

c = F.col
OHLCV = ("open", "high", "low", "close", "volume")
_OHLCV = ", ".join(r6(x, x) for x in OHLCV)
_RAW = f"SELECT symbol, date, {_OHLCV} FROM "
# The day that stands for today in the range sources.
TODAY = dt.date(2001, 6, 30)
CSV_SYMBOL = "STANDARD BURNISHED COPPER"


# Sources and sinks.
def _context_bars(spark, sf):
    return B.bars_with_context(I.raw_panel(spark, sf), "QQQ", 3, TODAY)


def _csv(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries: all columns in another order under other spellings, and one symbol's without its name."""
    path, bars = f"{work_folder(spark)}/csv-{uuid.uuid4().hex}", I.raw_bars(spark, sf)
    alone = c("symbol") == CSV_SYMBOL
    shuffled = bars.filter(~alone).select(
        c("date").alias("Date"), c("close").alias("Close"), c("volume"), c("symbol"), c("open").alias("OPEN"), c("low"), c("high"),
        c("close").alias("Adj Close"),
    )
    shuffled.write.csv(f"{path}/many", header=True)
    bars.filter(alone).select("date", "close", "open", "high", "low", "volume").write.csv(f"{path}/one", header=True)
    return B.read_bars_csv(spark, f"{path}/many").unionByName(B.read_bars_csv(spark, f"{path}/one", CSV_SYMBOL))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_folder(spark)}/stored-{uuid.uuid4().hex}"
    write_bars(I.raw_panel(spark, sf), path)
    return B.read_bars(spark, path)


def deliveries(bars: DataFrame) -> DataFrame:
    """Bars as a feed delivers them: once, and again with a corrected close in the month's second half."""
    first = bars.withColumn("arrival", F.lit(1))
    again = bars.filter(F.dayofmonth("date") > 15).withColumn("close", c("close") * 1.01)
    return first.unionByName(again.withColumn("arrival", F.lit(2)))


_DELIVERIES = """
  SELECT symbol, date, open, high, low, close, volume, 1 AS arrival FROM @t
  UNION ALL SELECT symbol, date, open, high, low, close * 101e-2, volume, 2 FROM @t WHERE day(date) > 15"""
_LAST = """
  SELECT symbol, date, open, high, low, close, volume FROM (SELECT *, row_number() OVER (
    PARTITION BY symbol, date ORDER BY arrival DESC) AS rn FROM deliveries) WHERE rn = 1"""


def _full_bars(spark, sf):
    return B.full_bars(deliveries(I.raw_panel(spark, sf)), I.calendar(spark, sf), "QQQ", 3, "arrival", TODAY)


def _feed(spark, sf):
    foreign = I.raw_bars(spark, sf).select(
        c("symbol").alias("Index Name"),
        c("date").cast("string").alias("Trade Date"),
        c("open").alias("Open"),
        c("high").alias("High"),
        c("low").alias("Low"),
        c("close").alias("Index Value"),
        c("volume").alias("Total Market Value"),
        F.lit(0.0).alias("Dividend Market Value"),
    )
    return B.from_feed(foreign, c("`Index Name`"))


def _event_bars(spark, sf):
    events = I.table(spark, sf, "events")
    return B.build_bars(events, c("event_type"), c("ts"), c("value") / 10 + 100, F.lit(1.0), I.event_bars_order())


_CONTEXT_CHECK_COLUMNS = ", ".join(r6(x, x) for x in (*LEVELS, *RATIOS))
_RANGE = "date BETWEEN DATE '1998-01-01' AND DATE '2001-06-30'"
_CLOSES_OF = {
    "src": f"SELECT * FROM raw_panel WHERE {_RANGE}",
}


def _context_sql(panel: str, final: str, extra: dict[str, str], base: str = "raw_panel calendar") -> str:
    from quotemill.plans.oracle_parts import PARTS

    blocks = extra | {
        "closes": PARTS["closes"].replace("FROM panel", f"FROM {panel}"),
        "context0": PARTS["context0"],
    }
    return sql(base, final, extra=blocks)


_QQQ = f"""SELECT symbol, date, {_OHLCV}, {_CONTEXT_CHECK_COLUMNS}, spy_bull
FROM (SELECT * FROM @p WHERE symbol = 'QQQ' AND close IS NOT NULL) LEFT JOIN context0 USING (date)"""

add("src1_context_bars", _context_bars, _context_sql("src", _QQQ.replace("@p", "src"), _CLOSES_OF))
add(
    "src2_bulk_bars",
    lambda s, d: B.bulk_bars(I.raw_panel(s, d), ["SPY", "QQQ", "AAPL", "CL"], 3, TODAY),
    sql(
        "raw_panel",
        f"""SELECT CASE symbol WHEN 'CL=F' THEN 'CL' ELSE symbol END AS symbol, date, {_OHLCV}
        FROM raw_panel WHERE symbol IN ('SPY', 'QQQ', 'AAPL', 'CL=F') AND {_RANGE}""",
    ),
)
add("src3_csv_bars", _csv, sql("raw_bars", _RAW + "raw_bars"))
add(
    "src4_full_bars",
    _full_bars,
    _context_sql(
        "src",
        _QQQ.replace("@p", "src") + " WHERE date IN (SELECT date FROM calendar)",
        {
            "deliveries": _DELIVERIES.replace("@t", "raw_panel"),
            "last_bars": _LAST,
            "src": f"SELECT * FROM last_bars WHERE {_RANGE}",
        },
    ),
)
add("src5_foreign_feed", _feed, sql("raw_bars", _RAW + "raw_bars"))
add("src6_line_bars", lambda s, d: I.line_bars(s, d, "p_type"), sql("raw_bars", _RAW + "raw_bars"))
add("src6_brand_bars", I.brand_bars, sql("raw_panel", _RAW + "raw_panel"))
add(
    "src6_event_bars",
    _event_bars,
    f"""SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
       {r6("arg_min(value / 10 + 100, row(ts, event_id))", "open")},
       {r6("max(value / 10 + 100)", "high")}, {r6("min(value / 10 + 100)", "low")},
       {r6("arg_max(value / 10 + 100, row(ts, event_id))", "close")}, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2""",
)
add("snk1_bar_table", _stored, sql("raw_panel", _RAW + "raw_panel"))

# Relational preparation.
add(
    "rel1_normalize",
    lambda s, d: R.normalize(R.capitalize(I.raw_bars(s, d)).withColumn("Date", c("Date").cast("string"))),
    sql("raw_bars", _RAW + "raw_bars"),
)
add("rel2_one_symbol", lambda s, d: R.one_symbol(I.raw_panel(s, d), "SPY"), sql("raw_panel", _RAW + "raw_panel WHERE symbol = 'SPY'"))
_futures = ", ".join(f"'{t}'" for t in FUTURES)
_currencies = ", ".join(f"'{t}'" for t in CURRENCIES)
add(
    "rel3_ticker_alias",
    lambda s, d: I.panel(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).select(
        "symbol", R.alias_column(c("symbol")).alias("feed_symbol"), "bars"
    ),
    sql(
        "panel",
        f"""SELECT symbol, CASE WHEN symbol IN ({_futures}) THEN symbol || '=F'
        WHEN symbol IN ({_currencies}) THEN symbol || '=X' ELSE symbol END AS feed_symbol, count(*) AS bars
        FROM panel GROUP BY 1""",
    ),
)
add("rel4_sessions_only", I.bars, sql("bars", _RAW + "bars"))
add(
    "rel5_last_arrival",
    lambda s, d: R.keep_last_arrival(deliveries(I.raw_bars(s, d)), "arrival").drop("arrival"),
    sql("raw_bars", _RAW + "last_bars", extra={"deliveries": _DELIVERIES.replace("@t", "raw_bars"), "last_bars": _LAST}),
)


def _gappy(bars: DataFrame) -> DataFrame:
    """Bars whose close is missing on every 13th."""
    return bars.withColumn("close", F.when(F.dayofmonth("date") != 13, c("close")))


add(
    "rel6_drop_null_close",
    lambda s, d: R.drop_null_close(_gappy(I.raw_bars(s, d))),
    sql("raw_bars", _RAW + "raw_bars WHERE day(date) <> 13"),
)
add(
    "rel7_drop_column",
    lambda s, d: R.drop_columns(I.raw_bars(s, d).withColumn("adj_close", c("close")), "adj_close", "not_there"),
    sql("raw_bars", _RAW + "raw_bars"),
)
add(
    "rel8_exclude_symbols",
    lambda s, d: R.exclude_symbols(I.raw_panel(s, d), ["^VIX", "RSP", "XLI", "XLU", "XLE", "XLF"]),
    sql("raw_panel", _RAW + "raw_panel WHERE symbol NOT IN ('^VIX', 'RSP', 'XLI', 'XLU', 'XLE', 'XLF')"),
)


def _appended(spark, sf):
    bars = I.raw_bars(spark, sf)
    return R.append_all(
        [
            bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")),
            bars.groupBy("symbol").agg(F.max("close").alias("best"), F.min("close").alias("worst")),
        ]
    )


add(
    "rel9_append",
    _appended,
    sql(
        "raw_bars",
        f"""SELECT symbol, count(*) AS bars, CAST(NULL AS DOUBLE) AS best, CAST(NULL AS DOUBLE) AS worst
        FROM raw_bars GROUP BY 1 UNION ALL
        SELECT symbol, NULL, {r6("max(close)", "best")}, {r6("min(close)", "worst")} FROM raw_bars GROUP BY 1""",
    ),
)
add(
    "rel10_first_and_last",
    lambda s, d: R.first_and_last(I.raw_bars(s, d), ["symbol"], ["date", "close"]),
    sql(
        "raw_bars",
        f"""SELECT symbol, min(date) AS first_date, max(date) AS last_date,
        {r6("arg_min(close, date)", "first_close")}, {r6("arg_max(close, date)", "last_close")}
        FROM raw_bars GROUP BY 1""",
    ),
)

# Context.
add(
    "ctx1_levels",
    lambda s, d: levels_and_ratios(I.panel(s, d)).select("date", *LEVELS),
    sql("closes", "SELECT date, " + ", ".join(r6(x, x) for x in LEVELS) + " FROM closes"),
)
add(
    "ctx2_ratios",
    lambda s, d: levels_and_ratios(I.panel(s, d)).select("date", *RATIOS),
    sql("context0", "SELECT date, " + ", ".join(r6(x, x) for x in RATIOS) + " FROM context0"),
)
_MARKET = "SELECT date, avg(close) AS spy FROM bars GROUP BY 1"
_FAST, _SLOW = (f"avg(spy) OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (50, 200))
add(
    "ctx3_regime_both_ways",
    lambda s, d: with_regime(I.bars(s, d).groupBy("date").agg(F.avg("close").alias("spy"))),
    sql(
        "bars",
        f"""SELECT date, {r6('spy', 'spy')},
          CASE WHEN row_number() OVER (ORDER BY date) >= 200 AND {_FAST} > {_SLOW} THEN 1 ELSE -1 END AS spy_bull FROM market""",
        extra={"market": _MARKET},
    ),
)
add(
    "ctx3_regime",
    lambda s, d: with_regime(levels_and_ratios(I.panel(s, d))).select("date", "spy", "spy_bull"),
    sql("context0", f"SELECT date, {r6('spy', 'spy')}, spy_bull FROM context0"),
)


# Windowed primitives.
def _window(name, build, check, source="bars"):
    """A query of window columns over the session bars; `build` gives them by name."""
    names = list(check)
    add(
        name,
        lambda s, d: I.bars(s, d).withColumns(build()).select("symbol", "date", *names),
        sql(source, "SELECT symbol, date, " + ", ".join(r6(x, n) for n, x in check.items()) + f" FROM {source}"),
    )


_window(
    "win1_shift",
    lambda: {f"close_{k}": W.lag("close", k) for k in (1, 2, 3)},
    {f"close_{k}": lag("close", k) for k in (1, 2, 3)},
)
_window(
    "win2_diff_pct_change",
    lambda: {
        "diff_1": W.diff(c("close")),
        "diff_10": W.diff(c("close"), 10),
        "pct_1": W.pct_change(c("close")),
        "pct_10": W.pct_change(c("close"), 10),
    },
    {
        "diff_1": f"close - {lag('close')}",
        "diff_10": f"close - {lag('close', 10)}",
        "pct_1": f"close / nullif({lag('close')}, 0) - 1",
        "pct_10": f"close / nullif({lag('close', 10)}, 0) - 1",
    },
)
_window(
    "win3_rolling_mean",
    lambda: {f"mean_{n}": W.rolling_mean(c("close"), n) for n in (2, 20, 200)},
    {f"mean_{n}": roll("close", n, "avg") for n in (2, 20, 200)},
)
_window(
    "win4_rolling_extremes",
    lambda: {"min_3": W.rolling_min(c("low"), 3), "max_14": W.rolling_max(c("high"), 14)},
    {"min_3": roll("low", 3, "min"), "max_14": roll("high", 14, "max")},
)
_window(
    "win5_rolling_sum",
    lambda: {"sum_10": W.rolling_sum(c("volume"), 10), "sum_80": W.rolling_sum(c("volume"), 80)},
    {"sum_10": roll("volume", 10, "sum"), "sum_80": roll("volume", 80, "sum")},
)
_window(
    "win6_rolling_std",
    lambda: {"std_5": W.rolling_std(c("close"), 5), "std_30": W.rolling_std(c("close"), 30)},
    {"std_5": roll("close", 5, "stddev_samp"), "std_30": roll("close", 30, "stddev_samp")},
)
_LONG = {
    **{f"{kind}_{n}": W.Rolled(kind, x, n) for kind, x in (("min", "low"), ("max", "high")) for n in (17, 200)},
    **{f"std_{n}": W.Rolled("std", "close", n) for n in (31, 100)},
}
add(
    "win4_long_extremes_and_deviations",
    lambda s, d: W.with_rolling(I.bars(s, d), _LONG).select("symbol", "date", *_LONG),
    sql(
        "bars",
        "SELECT symbol, date, "
        + ", ".join(r6(roll(r.source, r.n, {"std": "stddev_samp"}.get(r.kind, r.kind)), n) for n, r in _LONG.items())
        + " FROM bars",
    ),
)
_GAPPED = {"sum_17": "volume", "mean_55": "close", "mean_20": "close"}


def _long_with_gaps(spark, sf):
    """Values missing on single days, some closer to each other than the windows are long."""
    here = ~(F.dayofyear("date") % 47).isin(0, 9)
    bars = I.raw_bars(spark, sf).withColumns({x: F.when(here, c(x)) for x in ("low", "high", "close", "volume")})
    sums = {n: (W.rolling_sum if n.startswith("sum") else W.rolling_mean)(c(x), int(n.split("_")[1])) for n, x in _GAPPED.items()}
    long = {"min_20": W.Rolled("min", "low", 20), "max_33": W.Rolled("max", "high", 33), "std_18": W.Rolled("std", "close", 18)}
    return W.with_rolling(bars.withColumns(sums), long).select("symbol", "date", *sums, *long)


add(
    "win5_long_windows_gaps",
    _long_with_gaps,
    sql(
        "raw_bars",
        "SELECT symbol, date, "
        + ", ".join(
            r6(roll(x, n, agg), name)
            for name, x, n, agg in (
                ("sum_17", "volume", 17, "sum"), ("mean_55", "close", 55, "avg"), ("mean_20", "close", 20, "avg"),
                ("min_20", "low", 20, "min"), ("max_33", "high", 33, "max"), ("std_18", "close", 18, "stddev_samp"),
            )
        )
        + " FROM gapped",
        extra={
            "gapped": "SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, "
            + ", ".join(f"CASE WHEN dayofyear(date) % 47 NOT IN (0, 9) THEN {x} END AS {x}" for x in ("low", "high", "close", "volume"))
            + " FROM raw_bars"
        },
    ),
)
add(
    "win7_rolling_apply",
    lambda s, d: I.bars(s, d)
    .withColumn("_window", W.rolling_values(c("close"), 20))
    .select("symbol", "date", W.mean_abs_deviation(c("_window"), 20).alias("mean_deviation")),
    sql(
        "bars",
        f"""SELECT symbol, date, {r6("list_aggregate(list_transform(l, lambda x: abs(x - list_aggregate(l, 'avg'))), 'avg')",
        "mean_deviation")} FROM (SELECT *, {roll("close", 20, "list")} AS l FROM bars)""",
    ),
)


def _weighted(spark, sf):
    gappy = _gappy(I.bars(spark, sf))
    return W.with_ewm(gappy, {"weighted": "close"}, 3).select("symbol", "date", "weighted")


add(
    "win8_weighted_mean",
    _weighted,
    sql(
        "bars",
        f"SELECT symbol, date, {r6('num / nullif(den, 0)', 'weighted')} FROM w_rec",
        extra={
            "gappy": "SELECT *, CASE WHEN day(date) <> 13 THEN close END AS x FROM bars",
            "w_rec": """SELECT symbol, date, i, coalesce(x, 0) AS num, CASE WHEN x IS NULL THEN 0e0 ELSE 1e0 END AS den
              FROM gappy WHERE i = 1 UNION ALL
              SELECT b.symbol, b.date, b.i, coalesce(b.x, 0) + r.num / 2, CASE WHEN b.x IS NULL THEN 0e0 ELSE 1e0 END + r.den / 2
              FROM w_rec r JOIN gappy b ON b.symbol = r.symbol AND b.i = r.i + 1""",
        },
    ),
)


def _smoothed(*specs):
    def query(spark, sf):
        frame = with_smoothings(I.bars(spark, sf), specs)
        return frame.select("symbol", "date", *[x.name for x in specs])

    return query


def _with_gaps(column: str):
    """A column, missing on single days and on pairs of days."""
    return F.when(~F.dayofmonth("date").isin(1, 13, 14), c(column)).alias(column)


def _aged(mean: str, value: str) -> str:
    """One step of a mean over eight bars that ages over missing values."""
    old = "pow(7e0 / 9, r.missed + 1)"
    moved = f"({old} * r.{mean} + 2e0 / 9 * b.{value}) / ({old} + 2e0 / 9)"
    return f"CASE WHEN r.{mean} IS NULL THEN b.{value} WHEN b.{value} IS NULL THEN r.{mean} ELSE {moved} END"


add(
    "win9_ema",
    _smoothed(*[Smoothing(f"ema{n}", "ema", "close", (n,)) for n in (8, 20, 100)]),
    sql("ind1", f"SELECT symbol, date, {', '.join(r6(f'ema{n}', f'ema{n}') for n in (8, 20, 100))} FROM ind1"),
)
add(
    "win9_ema_gaps",
    lambda s, d: with_smoothings(
        I.raw_bars(s, d).select("symbol", "date", *[_with_gaps(x) for x in ("close", "volume")]),
        [Smoothing("ema8", "ema", "close", (8,)), Smoothing("volume_ema8", "ema", "volume", (8,))],
    ).select("symbol", "date", "ema8", "volume_ema8"),
    sql(
        "raw_bars",
        f"""SELECT symbol, date, {six("CASE WHEN i >= 8 THEN e END")} AS ema8, {six("CASE WHEN i >= 8 THEN ve END")} AS volume_ema8
        FROM aged""",
        extra={
            "gapped": """SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i,
              CASE WHEN day(date) NOT IN (1, 13, 14) THEN close END AS x, CASE WHEN day(date) NOT IN (1, 13, 14) THEN volume END AS v
              FROM raw_bars""",
            "aged": f"""SELECT symbol, date, i, x AS e, v AS ve, 0 AS missed FROM gapped WHERE i = 1 UNION ALL
              SELECT b.symbol, b.date, b.i, {_aged("e", "x")}, {_aged("ve", "v")},
                CASE WHEN b.x IS NULL AND r.e IS NOT NULL THEN r.missed + 1 ELSE 0 END
              FROM aged r JOIN gapped b ON b.symbol = r.symbol AND b.i = r.i + 1""",
        },
    ),
)
add(
    "win10_wilder",
    _smoothed(Smoothing("rsi14", "rsi", "close", (14,)), Smoothing("atr20", "atr", "close", (20,))),
    sql("ind1", f"SELECT symbol, date, {r6('rsi14', 'rsi14')}, {r6('atr20', 'atr20')} FROM ind1"),
)
_window(
    "win11_running_max",
    lambda: {"peak": W.running_max(c("close"))},
    {"peak": f"max(close) {over(None)}"},
)


# Scalar functions.
def _scalar(name, build, check, source="raw_bars"):
    names = list(check)
    add(
        name,
        lambda s, d: I.raw_bars(s, d).withColumns(build()).select("symbol", "date", *names),
        sql(source, "SELECT symbol, date, " + ", ".join(f"{x} AS {n}" for n, x in check.items()) + f" FROM {source}"),
    )


_scalar(
    "fn1_arithmetic",
    lambda: {
        "size": F.abs(c("close") - c("open")),
        "log_close": F.ln("close"),
        "root": F.sqrt("close"),
        "rounded": F.round(c("close") * 0.123457, 2),
        "loss": F.least(c("close") - c("open"), F.lit(0.0)),
        "safe": S.div(c("close"), c("high") - c("low")),
    },
    {
        "size": six("abs(close - open)"),
        "log_close": six("ln(close)"),
        "root": six("sqrt(close)"),
        "rounded": six("round(close * 123457e-6, 2)"),
        "loss": six("least(close - open, 0e0)"),
        "safe": six("close / nullif(high - low, 0)"),
    },
)
_scalar(
    "fn2_nested_where",
    lambda: {
        "shape": F.when(c("close") > c("open"), F.lit(1)).otherwise(S.flag(c("close") == c("open")) - 1),
        "up": S.flag(c("close") > c("open")),
    },
    {
        "shape": f"CASE WHEN close > open THEN 1 ELSE {flag('close = open')} - 1 END",
        "up": flag("close > open"),
    },
)
_scalar(
    "fn3_clip",
    lambda: {"clipped": S.clip_above(c("volume"), F.when(F.dayofmonth("date") != 13, F.lit(100.0)))},
    {"clipped": "CASE WHEN day(date) = 13 THEN NULL WHEN volume < 100 THEN volume ELSE 100e0 END"},
)
_scalar(
    "fn4_dates",
    lambda: {
        "weekday": F.weekday("date"),
        "year": F.year("date"),
        "parsed": F.to_date(F.date_format("date", "yyyy/MM/dd"), "yyyy/MM/dd"),
        "from_day": S.first_day_years_back(c("date"), 1),
    },
    {
        "weekday": "CAST(isodow(date) - 1 AS INTEGER)",
        "year": "CAST(year(date) AS INTEGER)",
        "parsed": "date",
        "from_day": "make_date(year(date) - 1, 1, 1)",
    },
)
_scalar(
    "fn5_formats",
    lambda: {"dollars": S.dollars(F.round(c("close") * 1000, 2)), "percent": S.percent(F.round(c("close") * 0.123457, 2))},
    {
        "dollars": "'$' || format('{:,.2f}', round(close * 1000, 2))",
        "percent": "format('{:.2f}', round(close * 123457e-6, 2)) || '%'",
    },
)
add(
    "fn6_capitalize",
    lambda s, d: R.capitalize(I.raw_bars(s, d)),
    sql(
        "raw_bars",
        "SELECT symbol AS \"Symbol\", date AS \"Date\", "
        + ", ".join(r6(x, f'"{x.capitalize()}"') for x in OHLCV)
        + " FROM raw_bars",
    ),
)
_scalar(
    "fn7_null_handling",
    lambda: {
        "in_list": c("symbol").isin("ECONOMY", "PROMO"),
        "present": F.when(F.dayofmonth("date") != 13, c("close")).isNotNull(),
        "filled": F.coalesce(F.when(F.dayofmonth("date") != 13, c("close")), F.lit(0.0)),
        "number": S.to_number(F.when(F.dayofmonth("date") == 13, F.lit("n/a")).otherwise(c("volume").cast("string"))),
        "whole": S.truncate_to_int(c("close")),
    },
    {
        "in_list": "symbol IN ('ECONOMY', 'PROMO')",
        "present": "day(date) <> 13",
        "filled": six("CASE WHEN day(date) <> 13 THEN close ELSE 0 END"),
        "number": "CASE WHEN day(date) <> 13 THEN volume END",
        "whole": "CAST(trunc(close) AS BIGINT)",
    },
)


def _grid(spark, sf):
    """Bars at or below each value of a grid, one row per value."""
    values = Axis("ibr", 0.1, 0.9, 0.1).values()
    tagged = I.raw_bars(spark, sf).select(F.explode(F.array(*[F.lit(v) for v in values])).alias("value"), "volume")
    return tagged.groupBy("value").agg(F.count_if(c("volume") <= c("value") * 100).alias("bars_below"))


add(
    "swp6_grid_values",
    _grid,
    sql(
        "raw_bars",
        f"""SELECT {r6('v / 1e1', 'value')}, count(*) FILTER (volume <= v / 1e1 * 100) AS bars_below
        FROM raw_bars, range(1, 10) AS g(v) GROUP BY 1""",
    ),
)


# Data quality: the session bars delivered twice on some dates, with gaps and crossed prices.
def _faulty(spark, sf):
    bars = _gappy(I.raw_bars(spark, sf))
    crossed = bars.withColumn("low", F.when(F.dayofmonth("date") == 7, c("high") + 1).otherwise(c("low")))
    return bad_bars(deliveries(crossed))


_BAD = """SELECT symbol, date, count(*) AS copies, count(*) FILTER (day(date) = 13) AS null_closes,
  count(*) FILTER (day(date) = 7) AS crossed FROM deliveries GROUP BY 1, 2
  HAVING count(*) > 1 OR day(date) IN (7, 13)"""


def _reported(spark, sf):
    path = f"{work_folder(spark)}/bad-dates-{uuid.uuid4().hex}"
    write_bad_dates(_faulty(spark, sf), path)
    return spark.read.csv(path, header=True, schema="symbol string, date date, copies long, null_closes long, crossed long")


for _name, _query in (("dq1_bad_bars", _faulty), ("snk2_bad_dates", _reported)):
    add(_name, _query, sql("raw_bars", _BAD, extra={"deliveries": _DELIVERIES.replace("@t", "raw_bars")}))


def _loaded(spark, sf) -> tuple[dict[str, int], str]:
    path = f"{work_folder(spark)}/loaded-{uuid.uuid4().hex}"
    bars = _gappy(I.raw_bars(spark, sf))
    crossed = bars.withColumn("low", F.when(F.dayofmonth("date") == 7, c("high") + 1).otherwise(c("low")))
    return load_bars(deliveries(crossed), path, "arrival"), path


add(
    "dq1_observed_load",
    lambda s, d: s.createDataFrame([_loaded(s, d)[0]], "rows long, null_closes long, crossed long, copies long, kept long, quarantined long"),
    sql(
        "raw_bars",
        """SELECT count(*) AS rows, count(*) FILTER (day(date) = 13) AS null_closes, count(*) FILTER (day(date) = 7) AS crossed,
          count(*) - count(DISTINCT row(symbol, date)) AS copies,
          count(DISTINCT row(symbol, date)) FILTER (day(date) NOT IN (7, 13)) AS kept,
          count(DISTINCT row(symbol, date)) FILTER (day(date) IN (7, 13)) AS quarantined FROM deliveries""",
        extra={"deliveries": _DELIVERIES.replace("@t", "raw_bars")},
    ),
)
_QUARANTINED = "SELECT symbol, date, " + r6("volume", "volume") + " FROM last_bars WHERE day(date) @w (7, 13)"
for _name, _part, _where in (("dq1_loaded_bars", "bars", "NOT IN"), ("dq1_quarantine", "quarantine", "IN")):
    add(
        _name,
        lambda s, d, part=_part: loaded_bars(s, _loaded(s, d)[1], part).select("symbol", "date", "volume"),
        sql("raw_bars", _QUARANTINED.replace("@w", _where), extra={"deliveries": _DELIVERIES.replace("@t", "raw_bars"), "last_bars": _LAST}),
    )
