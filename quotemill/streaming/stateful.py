"""Per-symbol state carried across micro-batches of bars, in typed columns of the state store.

A `Carried` processor sees each symbol's new bars once, in date order. Bars at or before the last date it has seen are
late and dropped, so replays after a restart change nothing. Of several copies of a bar in one micro-batch the last
arrival counts; without an arrival column, the largest by its values. What a symbol delivers in one
micro-batch is sorted as a whole: at most its history, one row per session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quotemill.functions.smoothing import Smoother, Smoothing
from quotemill.session import ship_package

#: The only store that keeps states of several columns and kinds per key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Carried(StatefulProcessor):
    """Hands each symbol's new bars, in date order, to `advance`; a subclass adds states of its own in `open`."""

    def __init__(self, arrival: str | None = None):
        self.arrival = arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last_day = handle.getValueState("last_day", "day long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        pass

    def advance(self, bars: pd.DataFrame, days: np.ndarray) -> Iterator[pd.DataFrame]:
        """Output rows of one symbol's new bars; `days` are their dates as day numbers."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf["_day"] = pd.to_datetime(pdf["date"]).to_numpy("datetime64[D]").astype("int64")
        if self.last_day.exists():
            pdf = pdf[pdf["_day"] > self.last_day.get()[0]]
        order = [self.arrival] if self.arrival else [c for c in pdf.columns if c != "_day"]
        pdf = pdf.sort_values(["_day", *order]).drop_duplicates("_day", keep="last").reset_index(drop=True)
        if not len(pdf):
            return
        days = pdf.pop("_day").to_numpy()
        yield from self.advance(pdf, days)
        self.last_day.update((int(days[-1]),))

    def close(self) -> None:
        pass


class Recurrences(Carried):
    """Bars with their recurrences; each one's running values are a state of its own."""

    def __init__(self, specs: Sequence[Smoothing], arrival: str | None = None):
        super().__init__(arrival)
        self.specs = list(specs)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.running = {s.name: handle.getValueState(s.name, Smoother.state_schema(s)) for s in self.specs}

    def smoothed(self, bars: pd.DataFrame) -> pd.DataFrame:
        smoother = Smoother(self.specs)
        for name, state in self.running.items():
            if state.exists():
                smoother.steps[name].load(*state.get())
        bars = bars.assign(**smoother.push(bars))
        for name, state in self.running.items():
            state.update(smoother.steps[name].dump())
        return bars

    def advance(self, bars: pd.DataFrame, days: np.ndarray) -> Iterator[pd.DataFrame]:
        yield self.smoothed(bars)


class Tail(Recurrences):
    """New bars with their recurrences after the last `rows` bars before them, told apart by `fresh`.

    The bars before are a ring of typed rows in the state; `columns` names what a row holds besides its day.
    """

    def __init__(self, specs: Sequence[Smoothing], columns: Sequence[str], rows: int):
        super().__init__(specs)
        self.columns, self.rows = list(columns), rows

    def open(self, handle: StatefulProcessorHandle) -> None:
        super().open(handle)
        fields = ", ".join(f"{c} double" for c in self.columns)
        self.ring = handle.getListState("ring", f"day long, {fields}")

    def advance(self, bars: pd.DataFrame, days: np.ndarray) -> Iterator[pd.DataFrame]:
        bars = self.smoothed(bars)
        own = pd.DataFrame({"day": days, **{c: bars[c].to_numpy(float) for c in self.columns}})
        held = sorted(self.ring.get(), key=lambda row: row[0])
        before = pd.DataFrame(held, columns=own.columns).astype(own.dtypes)
        rows = pd.concat([before.assign(fresh=False), own.assign(fresh=True)], ignore_index=True)
        kept = rows[["day", *self.columns]].tail(self.rows)
        self.ring.put([(int(r[0]), *[None if x != x else float(x) for x in r[1:]]) for r in kept.itertuples(index=False)])
        rows["date"] = rows.pop("day").to_numpy().astype("datetime64[D]")
        yield rows.assign(symbol=bars["symbol"].iloc[0], date=rows["date"].dt.date)[["symbol", "date", *self.columns, "fresh"]]


def carry(bars: DataFrame, processor: Carried, schema: T.StructType) -> DataFrame:
    """Run a processor over a bar stream, keyed by symbol."""
    spark = bars.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return bars.groupBy("symbol").transformWithStateInPandas(processor, schema, "append", "none")
