"""Streaming bars: raw events aggregated per symbol and day, emitted when the day is closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.schema import BAR_COLUMNS, BAR_SCHEMA
from quotemill.sources.bars import bar_aggregates


def stream_bars(
    events: DataFrame, symbol: Column, time: Column, price: Column, size: Column, order: Column, delay: str
) -> DataFrame:
    """Daily bars of an event stream; events later than `delay` after the watermark are dropped.

    The aggregates are the batch builder's. In append mode a day is emitted once the watermark passes
    its end, so the open day is held back.
    """
    records = events.select(
        symbol.alias("symbol"),
        time.cast("timestamp").alias("_time"),
        price.alias("_price"),
        size.alias("_size"),
        order.alias("_order"),
    )
    daily = records.withWatermark("_time", delay).groupBy("symbol", F.window("_time", "1 day").alias("_day"))
    bars = daily.agg(*bar_aggregates())
    return bars.withColumn("date", F.to_date("_day.start")).select(*BAR_COLUMNS)


def stream_bar_table(spark: SparkSession, path: str) -> DataFrame:
    """New rows of a bar table as they are appended."""
    return spark.readStream.schema(BAR_SCHEMA).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all rows available now to a table, then stop; a later call goes on from the checkpoint."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
