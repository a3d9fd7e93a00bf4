"""Registered queries: streams run to the end of what is available, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions.smoothing import Smoothing
from quotemill.operators import rules as RU
from quotemill.plans import inputs as I
from quotemill.plans.catalog_positions import OPEN, TIMED, _blocks
from quotemill.plans.oracle_parts import log_growth as log_sql
from quotemill.plans.oracle_parts import needs_context, r6, rule_source, six, sql
from quotemill.plans.registry import add, log_growth
from quotemill.session import work_folder
from quotemill.sources.increments import accept_late, add_delivery, late_records, partials, stored_bars, stream_records
from quotemill.streaming.bars import drain, stream_bar_table, stream_bars
from quotemill.streaming.monitor import read_monitor, run_monitor
from quotemill.streaming.smoothing import stream_smoothings

c = F.col
DELAY = "10 minutes"


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = I.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained_bars(spark: SparkSession, sf_dir: str) -> str:
    path = _fresh(spark, "stream-bars")
    bars = stream_bars(
        event_stream(spark, sf_dir), c("event_type"), c("ts"), c("value") / 10 + 100, F.lit(1.0),
        I.event_bars_order(), DELAY,
    )
    drain(bars, path, path + "-checkpoint")
    return path


_EVENT_BARS = {
    "event_bars": f"""SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
      arg_min(value / 10 + 100, row(ts, event_id)) AS open, max(value / 10 + 100) AS high, min(value / 10 + 100) AS low,
      arg_max(value / 10 + 100, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM events GROUP BY 1, 2""",
    "src_bars": f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM event_bars
      WHERE date + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL {DELAY}""",
}
add(
    "str1_stream_bars",
    lambda s, d: s.read.parquet(_drained_bars(s, d)),
    sql(
        "",
        "SELECT symbol, date, " + ", ".join(r6(x, x) for x in ("open", "high", "low", "close", "volume")) + " FROM src_bars",
        extra=_EVENT_BARS,
    ),
)


def _delivered(spark, bars: DataFrame):
    """Writes the bars in three deliveries, oldest first; yields the stream over them after each."""
    source = _fresh(spark, "delivered")
    first, last = bars.agg(F.min("date"), F.max("date")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    for part in (c("date") < cuts[0], (c("date") >= cuts[0]) & (c("date") <= cuts[1]), c("date") > cuts[1]):
        bars.filter(part).write.mode("append").parquet(source)
        yield stream_bar_table(spark, source)


# Records in three deliveries by time, some of them one delivery behind; a record may change a day of the last three.
PATIENCE = 3
_BEHIND = 10


def _record() -> dict:
    """How an event makes a bar."""
    return dict(symbol=c("event_type"), time=c("ts"), price=c("value") / 10 + 100, size=F.lit(1.0), order=I.event_bars_order())


def _taken_in(spark, sf_dir: str, patience: int | None) -> str:
    """A store that has taken the deliveries from a stream, the last of them twice."""
    events, source, path = I.table(spark, sf_dir, "events"), _fresh(spark, "records"), _fresh(spark, "kept-bars")
    day = F.to_date("ts")
    first, last = events.agg(F.min(day), F.max(day)).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    third = (day > cuts[0]).cast("int") + (day > cuts[1]).cast("int")
    number = F.least(F.lit(2), third + (c("event_id") % _BEHIND == 3).cast("int"))
    for k in range(3):
        events.where(number == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        stream_records(stream, path, path + "-checkpoint", patience, **_record())
    add_delivery(partials(events.where(number == 2), **_record()), path, 2, patience)
    return path


_DELIVERED = {
    "numbered": f"""SELECT *, CAST(ts AS DATE) AS day, least(2, CAST(CAST(ts AS DATE) > f + CAST(floor((l - f) / 3) AS INTEGER) AS INTEGER)
        + CAST(CAST(ts AS DATE) > f + CAST(floor((l - f) * 2 / 3) AS INTEGER) AS INTEGER) + CAST(event_id % {_BEHIND} = 3 AS INTEGER)) AS delivery
      FROM events, (SELECT min(CAST(ts AS DATE)) AS f, max(CAST(ts AS DATE)) AS l FROM events)""",
    "newest": "SELECT k AS delivery, (SELECT max(day) FROM numbered n WHERE n.delivery < k) AS last_day FROM range(3) AS r(k)",
    "judged": f"SELECT n.*, coalesce(day < last_day - {PATIENCE}, false) AS late FROM numbered n JOIN newest USING (delivery)",
}
_KEPT_BARS = f"""SELECT event_type AS symbol, day AS date, {r6("arg_min(value / 10 + 100, row(ts, event_id))", "open")},
  {r6("max(value / 10 + 100)", "high")}, {r6("min(value / 10 + 100)", "low")},
  {r6("arg_max(value / 10 + 100, row(ts, event_id))", "close")}, CAST(count(*) AS DOUBLE) AS volume FROM judged WHERE @w GROUP BY 1, 2"""
add(
    "str1_late_records_kept_out",
    lambda s, d: stored_bars(s, _taken_in(s, d, PATIENCE)),
    sql("", _KEPT_BARS.replace("@w", "NOT late"), extra=_DELIVERED),
)
add(
    "str1_late_records_counted",
    lambda s, d: late_records(s, _taken_in(s, d, PATIENCE)).select("delivery", "symbol", "date", "records", "volume"),
    sql(
        "",
        """SELECT CAST(delivery AS INTEGER) AS delivery, event_type AS symbol, day AS date, count(*) AS records, CAST(count(*) AS DOUBLE) AS volume
        FROM judged WHERE late GROUP BY 1, 2, 3""",
        extra=_DELIVERED,
    ),
)


def _accepted(spark, sf_dir):
    path = _taken_in(spark, sf_dir, PATIENCE)
    accept_late(spark, path)
    return stored_bars(spark, path)


add("src6_late_records_accepted", _accepted, sql("", _KEPT_BARS.replace("@w", "true"), extra=_DELIVERED))
add(
    "src6_incremental_bars",
    lambda s, d: stored_bars(s, _taken_in(s, d, None)),
    sql("", _KEPT_BARS.replace("@w", "true"), extra=_DELIVERED),
)


def _stream_ema(spark, sf_dir):
    """Bars arrive in three deliveries; each run goes on from the state of the one before."""
    out = _fresh(spark, "stream-ema")
    specs = [Smoothing("ema8", "ema", "close", (8,)), Smoothing("rsi2", "rsi", "close", (2,))]
    for stream in _delivered(spark, spark.read.parquet(_drained_bars(spark, sf_dir))):
        drain(stream_smoothings(stream, specs), out, out + "-checkpoint")
    return spark.read.parquet(out).select("symbol", "date", "ema8", "rsi2")


add(
    "str2_stream_smoothing",
    _stream_ema,
    sql(
        "",
        f"""SELECT symbol, date, {six("CASE WHEN i >= 8 THEN e END")} AS ema8, {six(
            "CASE WHEN i >= 2 THEN CASE WHEN d = 0 THEN 100e0 ELSE 100 - 100 / (1 + u / d) END END")} AS rsi2 FROM e_rec""",
        extra=_EVENT_BARS
        | {
            "e_rec": """SELECT symbol, date, i, close, close AS e, 0e0 AS u, 0e0 AS d FROM src_bars WHERE i = 1 UNION ALL
              SELECT b.symbol, b.date, b.i, b.close, b.close * (2e0 / 9) + r.e * (7e0 / 9),
                (greatest(b.close - r.close, 0) + r.u) / 2, (greatest(r.close - b.close, 0) + r.d) / 2
              FROM e_rec r JOIN src_bars b ON b.symbol = r.symbol AND b.i = r.i + 1"""
        },
    ),
)


def _monitored(spark, sf_dir, *names):
    """Raw bars arrive in three deliveries; each run goes on from the state of the one before."""
    rules = [RU.RULES[n] for n in names]
    folder = _fresh(spark, "monitor")
    context = I.context(spark, sf_dir) if needs_context(*names) else None
    for stream in _delivered(spark, I.bars(spark, sf_dir)):
        run_monitor(stream, rules, folder, context=context)
    return read_monitor(spark, folder).withColumn("log_equity", log_growth("equity")).drop("equity")


for _name, _rules in (
    ("str3_stream_monitor", (TIMED, "rule16")),
    ("str3_stream_monitor_open", (OPEN,)),
    ("str3_stream_monitor_context", ("rule09", "rule11")),
):
    add(
        _name,
        lambda s, d, rules=_rules: _monitored(s, d, *rules),
        sql(
            rule_source(*_rules),
            f"""SELECT symbol, signal, date, tin AS buy_now, hold AS holding, tout AS sell_now, {r6("trade_pnl", "trade_pnl")},
              {six(log_sql("equity"))} AS log_equity FROM played""",
            extra=_blocks(_rules, open_ended=OPEN in _rules),
        ),
    )
