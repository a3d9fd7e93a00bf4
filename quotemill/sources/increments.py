"""Bars kept up to date delivery by delivery, late records and all.

Beside each bar the store keeps what makes it mergeable: the order of its first and last record and their number. A delivery is
aggregated once to such partials; only the months it touches are read and merged again, whatever the length of history.
A record that belongs to a day more than `patience` days before the newest day of earlier deliveries is late: it
changes no bar, and its partial is set aside, counted, until `accept_late` merges it. Deliveries are numbered, and one that is
there already is skipped, so a delivery may be sent again. A manifest names the current folder of each month and is switched
by one rename: readers see the bars before a delivery or after it.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.schema import BAR_COLUMNS
from quotemill.sources.sinks import Manifest

PARTIAL_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("first_order", T.DecimalType(38, 0)),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("last_order", T.DecimalType(38, 0)),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("records", T.LongType()),
    ]
)


def partials(records: DataFrame, symbol: Column, time: Column, price: Column, size: Column, order: Column) -> DataFrame:
    """One mergeable row per (symbol, date) of raw records; `order` is unique per record, see `order_key`.

    A record without a time belongs to no bar.
    """
    rows = records.select(
        symbol.alias("symbol"), F.to_date(time).alias("date"), price.cast("double").alias("_price"), size.cast("double").alias("_size"),
        order.cast("decimal(38,0)").alias("_order"),
    )
    return rows.where("date IS NOT NULL").groupBy("symbol", "date").agg(
        F.min("_order").alias("first_order"),
        F.min_by("_price", "_order").alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max("_order").alias("last_order"),
        F.max_by("_price", "_order").alias("close"),
        F.sum("_size").alias("volume"),
        F.count(F.lit(1)).alias("records"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Partials of one (symbol, date) put together; any grouping of the records gives the same."""
    return parts.groupBy("symbol", "date").agg(
        F.min("first_order").alias("first_order"),
        F.min_by("open", "first_order").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max("last_order").alias("last_order"),
        F.max_by("close", "last_order").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("records").alias("records"),
    )


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], PARTIAL_SCHEMA)
    return spark.read.schema(PARTIAL_SCHEMA).parquet(*[f"{path}/{f}" for f in folders])


def _month() -> Column:
    return F.date_format("date", "yyyy-MM").alias("_month")


def _put(spark: SparkSession, path: str, folders: dict[str, str], write: str, parts: list[tuple[str, str]]) -> dict[str, str]:
    """Merge new partials (month, folder) into the months they touch; the folders of all months."""
    touched = {month for month, _ in parts}
    old = [folders[m] for m in touched if m in folders]
    both = _read(spark, path, [folder for _, folder in parts] + old)
    rows = merged(both).withColumn("_month", _month()).repartition("_month", "symbol").sortWithinPartitions("_month", "symbol", "date")
    rows.write.partitionBy("_month").parquet(f"{path}/{write}/merged")
    return folders | {m: f"{write}/merged/_month={m}" for m in touched}


def add_delivery(rows: DataFrame, path: str, number: int, patience: int | None = None) -> bool:
    """Take `partials` of delivery `number` into the store; False if it is there already.

    `patience`: days before the newest day of earlier deliveries that a record may still change; None for any.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    manifest = Manifest(spark, path)
    version, state = manifest.current()
    if number <= state.get("delivery", -1):
        return False
    newest = dt.date.fromisoformat(state["newest"]) if state.get("newest") else None
    late = F.lit(False)
    if patience is not None and newest is not None:
        late = F.coalesce(F.col("date") < F.lit(newest - dt.timedelta(days=patience)), F.lit(False))
    write = f"data/{uuid.uuid4().hex}"
    # The records are aggregated in this one job; all that follows reads what it has written.
    rows.select(*PARTIAL_SCHEMA.names, late.alias("_late"), _month()).write.partitionBy("_late", "_month").parquet(f"{path}/{write}/new")
    whole = T.StructType([*PARTIAL_SCHEMA.fields, T.StructField("_late", T.BooleanType()), T.StructField("_month", T.StringType())])
    new = spark.read.schema(whole).parquet(f"{path}/{write}/new").groupBy("_late", F.col("_month").alias("month"))
    told = new.agg(F.sum("records").alias("n"), F.max("date").alias("last")).collect()
    fresh = [(r["month"], f"{write}/new/_late=false/_month={r['month']}") for r in told if not r["_late"]]
    folders = _put(spark, path, state["folders"], write, fresh) if fresh else state["folders"]
    last = max([r["last"] for r in told if not r["_late"]] + ([newest] if newest else []), default=None)
    aside = state.get("late", []) + [
        {"delivery": number, "records": r["n"], "folder": f"{write}/new/_late=true/_month={r['month']}", "month": r["month"]} for r in told if r["_late"]
    ]
    manifest.switch(version, {"folders": folders, "delivery": number, "newest": last and last.isoformat(), "late": aside})
    return True


def stored_bars(spark: SparkSession, path: str) -> DataFrame:
    """The bars of all deliveries so far, without late records."""
    _, state = Manifest(spark, path).current()
    return _read(spark, path.rstrip("/"), list(state["folders"].values())).select(*BAR_COLUMNS)


def late_records(spark: SparkSession, path: str) -> DataFrame:
    """What was set aside: delivery, and the partial of each symbol and date with its number of records."""
    _, state = Manifest(spark, path).current()
    found = [_read(spark, path.rstrip("/"), [x["folder"]]).withColumn("delivery", F.lit(x["delivery"])) for x in state.get("late", [])]
    out = spark.createDataFrame([], PARTIAL_SCHEMA).withColumn("delivery", F.lit(0))
    for part in found:
        out = out.unionByName(part)
    return out


def accept_late(spark: SparkSession, path: str) -> int:
    """Merge all that was set aside into the bars; returns the number of its records."""
    path = path.rstrip("/")
    manifest = Manifest(spark, path)
    version, state = manifest.current()
    aside = state.get("late", [])
    if aside:
        folders = _put(spark, path, state["folders"], f"data/{uuid.uuid4().hex}", [(x["month"], x["folder"]) for x in aside])
        manifest.switch(version, state | {"folders": folders, "late": []})
    return sum(x["records"] for x in aside)


def stream_records(records: DataFrame, path: str, checkpoint: str, patience: int | None, **columns: Column) -> None:
    """Take in all records of a stream that are there now, one delivery a micro-batch; `columns` as for `partials`."""

    def take(batch: DataFrame, number: int) -> None:
        add_delivery(partials(batch, **columns), path, number, patience)

    query = records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
