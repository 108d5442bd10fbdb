"""Stateful streams in the order of event time: rows wait in a list state until the watermark has passed them, so order holds across batches.

A timer at the earliest waiting row of a key fires once the watermark is beyond it; all rows that it has passed are then taken in order of time (ties
in the order of the other columns), one step each. Rows that come after their time has been dealt with are dropped, as they are by any watermark.
What is held for a key is the rows of about the watermark's delay and the step's state. Needs the RocksDB state store (use_rocksdb).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """step(state or None, row) -> (state, rows to give out); rows are tuples in the order of `rows`, whose first column is the time in microseconds."""

    def __init__(self, names: list[str], rows: StructType, state: StructType, out: list[str], step: Callable) -> None:
        self.names, self.rows, self.kept, self.out, self.step = names, rows, state, out, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.state = handle.getValueState("state", self.kept)
        self.done = handle.getValueState("done", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.done.get()[0] if self.done.exists() else -(2**62)
        new = []
        for pdf in rows:
            at = pdf["time"].astype("datetime64[us]").astype("int64").tolist()
            others = [[None if pd.isna(x) else x for x in pdf[c].tolist()] for c in self.names]
            new += [r for r in zip(at, *others) if r[0] // 1000 > until]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda r: tuple((x is None, 0 if x is None else x) for x in r)) if self.waiting.exists() else []
        now = [tuple(r) for r in waiting if r[0] // 1000 <= until]
        later = [tuple(r) for r in waiting[len(now) :]]
        state, given = (tuple(self.state.get()) if self.state.exists() else None), []
        for r in now:
            state, rows = self.step(state, r)
            given += [(*key, *x) for x in rows]
        if now:
            self.state.update(state)
            self.done.update((until,))
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(later[0][0] // 1000)
            else:
                self.waiting.clear()
        out = pd.DataFrame(given, columns=self.out)
        if "time" in self.out:
            out["time"] = pd.to_datetime(out["time"], unit="us", utc=True)
        yield out

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, names: list[str], state: str, out: str, step: Callable, late: str = "10 minutes") -> DataFrame:
    """A stream with a timestamp `time` -> key and `out` (a schema without the key) of what step gives for its rows, in order by key."""
    use_rocksdb(stream.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    rows = _parse_datatype_string("time long, " + ", ".join(f"{c} {kinds[c]}" for c in names))
    schema = _parse_datatype_string(f"{key} {kinds[key]}, {out}")
    processor = InOrder(names, rows, _parse_datatype_string(state), schema.names, step)
    return stream.select(key, "time", *names).withWatermark("time", late).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


def ordered_bars(trades: DataFrame, size: float, late: str = "10 minutes") -> DataFrame:
    """trades(symbol, time, price, qty) -> symbol, bar, volume, dollars, close of bars of `size` units, over trades in order of time across batches. A trade is split over the bars it fills."""

    def step(state, row):
        bar, held, dollars = state or (0, 0.0, 0.0)
        _, price, qty = row
        out = []
        while held + qty >= size:
            part = size - held
            out.append((bar, float(size), dollars + price * part, price))
            bar, held, dollars, qty = bar + 1, 0.0, 0.0, qty - part
        return (bar, held + qty, dollars + price * qty), out

    return in_order(trades, "symbol", ["price", "qty"], "bar long, held double, dollars double", "bar long, volume double, dollars double, close double", step, late)


def monitored(rows: DataFrame, level: float = 0.03, least_dollars: float = 300_000.0, lookback: int = 6, late: str = "10 minutes") -> DataFrame:
    """rows(ticker, time, premium, dollars, listed) -> ticker, time, mean, last, dollars: candles at which the mean premium of the last `lookback` ones is beyond the level and the candle's dollars are over the least, while the ticker is listed.

    A row with `listed` set is an entry of the ticker table, true or false from its time on, and no candle: the table is part of the stream, so a
    refresh by the hour takes effect in order. Tickers without an entry are not listed; unlisting forgets the candles.
    """

    def step(state, row):
        listed, held = state or (False, [])
        at, premium, dollars, flag = row
        if flag is not None:
            return (bool(flag), list(held) if flag else []), []
        held = [*held, premium][-lookback:] if listed and premium is not None else list(held)
        mean = sum(held) / len(held) if len(held) == lookback else None
        alert = listed and premium is not None and mean is not None and abs(mean) > level and (dollars or 0.0) > least_dollars
        return (listed, held), [(at, mean, premium, dollars)] if alert else []

    return in_order(rows, "ticker", ["premium", "dollars", "listed"], "listed boolean, held array<double>", "time timestamp, mean double, last double, dollars double", step, late)
