"""Streams: quotes in tumbling candles, the sliding premium of two venues with its alerts, and bars that carry what is left over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candles(quotes: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """quotes(symbol, time, price, qty), a stream or a table -> symbol, start, close mean, dollars and count of each tumbling window. Quotes later than `late` are dropped by a stream."""
    q = quotes.withWatermark("time", late) if quotes.isStreaming else quotes
    g = q.groupBy("symbol", F.window("time", length).alias("w")).agg(F.avg("price").alias("price"), F.sum(F.col("price") * F.col("qty")).alias("dollars"), F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("w.start").alias("start"), "price", "dollars", "n")


def premiums(quotes: DataFrame, quote: str, base: str, length: str = "30 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, premium, dollars: mean price of `quote` over that of `base`, less one, in windows of `length` each `step`. One aggregation over
    both symbols in place of a join of two streams, so one state and one watermark; windows without one of the two have no premium."""
    q = quotes.where(F.col("symbol").isin(quote, base))
    q = q.withWatermark("time", late) if q.isStreaming else q
    of = lambda s, c: F.avg(F.when(F.col("symbol") == s, c))
    g = q.groupBy(F.window("time", length, step).alias("w")).agg(of(quote, F.col("price")).alias("a"), of(base, F.col("price")).alias("b"), F.sum(F.when(F.col("symbol") == quote, F.col("price") * F.col("qty"))).alias("dollars"))
    return g.select(F.col("w.start").alias("start"), (F.col("a") / F.col("b") - 1).alias("premium"), "dollars")


def alerts(premium: DataFrame, level: float = 0.03, least_dollars: float = 300_000.0) -> DataFrame:
    return premium.where((F.abs("premium") > level) & (F.col("dollars") > least_dollars))


def carried_bars(trades: DataFrame, size: float) -> DataFrame:
    """A stream of trades(symbol, time, price, qty) -> symbol, bar, volume, dollars, close of bars of `size` units. What is left after the last full
    bar of a batch is carried in the state to the next. Trades are taken in the order of time within a batch; a trade is split over the bars it fills."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bar, held, dollars = state.get if state.exists else (0, 0.0, 0.0)
        rows = []
        for pdf in [pd.concat(list(batches)).sort_values("time", kind="stable")]:
            for price, qty in zip(pdf["price"].tolist(), pdf["qty"].tolist()):
                while held + qty >= size:
                    part = size - held
                    rows.append((key[0], bar, float(size), dollars + price * part, price))
                    bar, held, dollars, qty = bar + 1, 0.0, 0.0, qty - part
                held, dollars = held + qty, dollars + price * qty
        state.update((bar, float(held), float(dollars)))
        yield pd.DataFrame(rows, columns=["symbol", "bar", "volume", "dollars", "close"])

    types = {f.name: f.dataType.simpleString() for f in trades.schema}
    out, kept = f"symbol {types['symbol']}, bar long, volume double, dollars double, close double", "bar long, held double, dollars double"
    return trades.groupBy("symbol").applyInPandasWithState(run, out, kept, "append", "NoTimeout")
