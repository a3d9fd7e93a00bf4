"""Streaming rule monitor: raw bars in, the state of each rule's position after every new bar out.

Two queries under one folder, each with its own checkpoint, both started by `run_monitor`:

1. `flags`: each symbol's recurrences are carried as typed state, and so are its last bars, as many as the rules look
   back. A micro-batch thus holds, for the symbols that have new bars, all that decides their flags; the rules are the
   same window expressions as in batch, over these few rows. Flags of a micro-batch replace what an earlier
   attempt at it has written.
2. `monitor`: each rule's position is a typed row of state, played on by the machine of the batch job.

Nothing is read twice and no history is rebuilt: a day's bars cost their symbols' rings, whatever the length of history.
Context, if a rule reads it, is a table by date that must hold a bar's date when the bar arrives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from quotemill.operators.indicators import recurrences
from quotemill.operators.machines import Run, machine_for
from quotemill.operators.positions import kernel_input, matrix, split_by_machine
from quotemill.operators.rules import Rule, rule_columns, rule_reach, with_rules
from quotemill.params import DEFAULT, Params
from quotemill.schema import BAR_SCHEMA, PRICE_COLUMNS
from quotemill.streaming.bars import drain
from quotemill.streaming.stateful import Carried, Tail, carry

MONITOR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("buy_now", T.BooleanType()),
        T.StructField("holding", T.BooleanType()),
        T.StructField("sell_now", T.BooleanType()),
        T.StructField("trade_pnl", T.DoubleType()),
        T.StructField("equity", T.DoubleType()),
    ]
)


def with_tails(bars: DataFrame, rules: Sequence[Rule], params: Params = DEFAULT) -> DataFrame:
    """New bars with their recurrences, after the bars before them that the rules look back to (`fresh` is false)."""
    names = rule_columns(rules, params)
    specs = recurrences(names)
    columns = [*PRICE_COLUMNS, *[s.name for s in specs]]
    fields = [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    fields += [T.StructField(c, T.DoubleType()) for c in columns] + [T.StructField("fresh", T.BooleanType())]
    return carry(bars, Tail(specs, columns, rule_reach(rules, params)), T.StructType(fields))


def flagged(tails: DataFrame, rules: Sequence[Rule], params: Params = DEFAULT, context: DataFrame | None = None) -> DataFrame:
    """Flags of the fresh bars of one micro-batch of `with_tails`, in the shape the machines read."""
    wide = with_rules(tails, rules, params, context, extra=["fresh"])
    return kernel_input(wide, rules, params, "fresh").where("fresh").drop("fresh")


def flag_schema(rules: Sequence[Rule]) -> T.StructType:
    flags = [f"{side}_{r.name}" for r in rules for side in ("buy", "sell")]
    fields = [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("close", "track_change")]
    return T.StructType(fields + [T.StructField(c, T.BooleanType()) for c in ("one_day_buy", *flags)])


class Positions(Carried):
    """Plays rules over flagged bars; each rule's position is a row of the map state, keyed by its name."""

    RUN = (
        "hold boolean, trade_in boolean, trade_out boolean, days_in_trade int, profitable_closes int, trade_entry double, "
        "entry_day long, trade_pnl double, equity double, was_buy boolean"
    )

    def __init__(self, rules: Sequence[Rule], params: Params):
        super().__init__()
        self.params = params
        # Conditions stay behind; a machine needs names and limits.
        self.groups = {
            open_ended: ([r.name for r in group], [Run(r.days, r.profit, r.is_long) for r in group])
            for open_ended, group in split_by_machine(rules).items()
        }

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("positions", "signal string", self.RUN)
        self.series = handle.getValueState("series", "previous_close double, was_one_day boolean")

    def advance(self, bars: pd.DataFrame, days: np.ndarray) -> Iterator[pd.DataFrame]:
        close, track = bars["close"].to_numpy(float), bars["track_change"].to_numpy(float)
        one_day = bars["one_day_buy"].to_numpy(bool)
        series = self.series.get() if self.series.exists() else None
        for open_ended, (names, runs) in self.groups.items():
            machine = machine_for(runs, self.params, open_ended)
            if series is not None:
                machine.load([self.places.getValue((n,)) for n in names], *series)
            buy, sell = (matrix(bars, [f"{side}_{n}" for n in names]) for side in ("buy", "sell"))
            out = machine.advance(close, track, days, buy, sell, one_day)
            for k, (name, row) in enumerate(zip(names, machine.dump(), strict=True)):
                self.places.updateValue((name,), row)
                yield pd.DataFrame(
                    {
                        "symbol": bars["symbol"],
                        "signal": name,
                        "date": bars["date"],
                        "buy_now": out["trade_in"][:, k],
                        "holding": out["hold"][:, k],
                        "sell_now": out["trade_out"][:, k],
                        "trade_pnl": out["trade_pnl"][:, k],
                        "equity": out["equity"][:, k],
                    }
                )
        last = close[-1]
        self.series.update((None if np.isnan(last) else float(last), bool(one_day[-1])))


def stream_monitor(flags: DataFrame, rules: Sequence[Rule], params: Params = DEFAULT) -> DataFrame:
    """Play rules over a stream of flagged bars; one output row per bar and rule."""
    return carry(flags, Positions(rules, params), MONITOR_SCHEMA)


def run_monitor(
    bars: DataFrame, rules: Sequence[Rule], folder: str, params: Params = DEFAULT, context: DataFrame | None = None
) -> None:
    """Take in all bars that are there now; a later call on the same folder goes on from there.

    `bars` is a stream of the bar contract. The rules of a folder stay the same: their state is keyed by name.
    """
    spark = bars.sparkSession
    flags = f"{folder}/flags"

    def flag(batch: DataFrame, number: int) -> None:
        flagged(batch, rules, params, context).write.mode("overwrite").parquet(f"{flags}/batch={number}")

    # A folder that holds nothing yet cannot be streamed.
    spark.createDataFrame([], flag_schema(rules)).write.mode("ignore").parquet(f"{flags}/batch=-1")
    query = (
        with_tails(bars.select(*BAR_SCHEMA.names), rules, params)
        .writeStream.foreachBatch(flag)
        .option("checkpointLocation", f"{folder}/flags-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = flag_schema(rules)
    flag_stream = spark.readStream.schema(schema).parquet(flags).select(*schema.names)
    drain(stream_monitor(flag_stream, rules, params), f"{folder}/monitor", f"{folder}/monitor-checkpoint")


def read_monitor(spark: SparkSession, folder: str) -> DataFrame:
    """One row per bar and rule of all that `run_monitor` has taken in."""
    return spark.read.schema(MONITOR_SCHEMA).parquet(f"{folder}/monitor")


def firing(monitor: DataFrame) -> DataFrame:
    """Bars on which a rule buys or sells."""
    return monitor.filter(F.col("buy_now") | F.col("sell_now"))
