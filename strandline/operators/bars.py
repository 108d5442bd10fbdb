"""Bars: from trades by time, volume, dollars or count, and from other bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.scratch import cut

from .blocks import BLOCK, before_blocks, block_of, within


def number_bars(df: DataFrame, key: str = "symbol", time: str = "time") -> DataFrame:
    """Adds bar_id: 0, 1, ... in time order for each key."""
    return df.withColumn("bar_id", (F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1).cast("long"))


def hourly_bars(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Open, high, low, close, volume, dollar and count of trades by symbol and time unit. One shuffle with partial sums."""
    at = F.struct("time", "id")
    bars = ticks.groupBy("symbol", F.date_trunc(unit, "time").cast("timestamp_ntz").alias("time")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("dollar"), F.count(F.lit(1)).alias("n"))
    return bars


def _ruled(ticks: DataFrame, block: str | int) -> DataFrame:
    """ticks with _block, up, and first: whether a trade is its symbol's first."""
    by, at = ["symbol"], F.struct("time", "id")
    t = before_blocks(ticks.withColumn("_block", block_of(ticks, "time", block)), by, "_block", lasts={"_price": (F.col("price"), at)})
    w = within(by, "_block", "time", "id")
    t = t.withColumn("_n", F.row_number().over(w)).withColumn("_was", F.when(F.col("_n") == 1, F.col("_price")).otherwise(F.lag("price").over(w)))
    change = F.signum(F.col("price") - F.col("_was"))
    t = t.withColumn("_c", F.when(change != 0, change)).withColumn("first", (F.col("_n") == 1) & F.col("_price").isNull()).drop("_n", "_was", "_price")
    t = before_blocks(cut(t), by, "_block", lasts={"_up": (F.col("_c"), at)})
    return t.withColumn("up", F.coalesce(F.last("_c", ignorenulls=True).over(w), "_up")).drop("_c", "_up")


def tick_rule(ticks: DataFrame, block: str | int = BLOCK) -> DataFrame:
    """Adds up: 1, 0 or -1 by the last price change that was not null; the first trade of a symbol has none. Zero changes carry on.

    Windows are by (symbol, block of time); prices and changes are carried over blocks. Prices aren't null.
    """
    return _ruled(ticks, block).drop("_block", "first")


def size_of(kind: str) -> Column:
    """What a trade adds to a bar: its volume, its dollars in cents, or one. Whole numbers, so that sums are exact."""
    return {"volume": F.col("qty"), "dollar": F.round(F.col("price") * F.col("qty") * 100).cast("long"), "tick": F.lit(1).cast("long")}[kind]


def tick_bars(ticks: DataFrame, size: int, kind: str = "volume", block: str | int = BLOCK) -> DataFrame:
    """Bars of `size` units. A trade that crosses a multiple of size is split there once, so one that spans several bars makes
    one large bar; the first trade never crosses. What is left after the last full bar (under 0.999 of size) is not a bar.

    Windows are by (symbol, block of time), whatever a symbol's history: units and crossings so far are sums of the blocks before
    and of the rows before in the block. There is no state by file, so the cut of the input doesn't matter.
    """
    by = ["symbol"]
    w = within(by, "_block", "time", "id")
    t = before_blocks(cut(_ruled(ticks, block).withColumn("target", size_of(kind))), by, "_block", sums={"_units": F.col("target")})
    t = t.withColumn("cum", F.col("_units") + F.sum("target").over(w))
    t = t.withColumn("crossed", ~F.col("first") & (F.floor(F.col("cum") / size) > F.floor((F.col("cum") - F.col("target")) / size)))
    t = before_blocks(cut(t.drop("_units")), by, "_block", sums={"_bars": F.col("crossed").cast("int")})
    rest = F.col("cum") % size
    whole = F.struct(F.col("target").alias("part"), F.lit(0).alias("piece"))
    parts = F.when(F.col("crossed") & (rest > 0), F.array(F.struct((F.col("target") - rest).alias("part"), F.lit(0).alias("piece")), F.struct(rest.alias("part"), F.lit(1).alias("piece")))).otherwise(F.array(whole))
    # The piece after a crossing opens a bar, and so does the trade after one that ends on a multiple: a trade's bar is the number of crossings before it.
    opened = F.col("_bars") + F.coalesce(F.sum(F.col("crossed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("bar", opened).withColumn("p", F.explode(parts)).withColumn("part", F.col("p.part")).withColumn("piece", F.col("p.piece")).withColumn("bar", F.col("bar") + F.col("piece"))
    share, at = F.col("part") / F.col("target"), F.struct("time", "id", "piece")
    qty = F.col("qty") * share
    dollar = F.col("price") * qty
    buy = F.coalesce(F.col("up") < 0, F.lit(False))  # an uptick counts as made by the buyer, so buys are the rest
    bars = t.groupBy("symbol", "bar").agg(
        F.min("time").alias("time0"), F.max("time").alias("time1"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum(qty).alias("volume"), F.sum(F.when(buy, qty).otherwise(0.0)).alias("volume_buy"), F.sum(dollar).alias("dollar"), F.sum(F.when(buy, dollar).otherwise(0.0)).alias("dollar_buy"),
        F.count("up").alias("tick"), F.sum("up").cast("long").alias("net_tick"), F.sum("part").alias("units"))
    return bars.withColumn("vwap", F.col("dollar") / F.col("volume")).where(F.col("units") >= 0.999 * size).drop("units")


def auto_size(ticks: DataFrame, minutes: float, kind: str = "volume") -> DataFrame:
    """symbol, size: the units of a bar that takes so many minutes on average, to four significant figures."""
    span = (F.unix_micros(F.max("time").cast("timestamp")) - F.unix_micros(F.min("time").cast("timestamp"))) / 60e6
    s = ticks.groupBy("symbol").agg((F.sum(size_of(kind)) / (span / minutes)).alias("raw"))
    digits = F.pow(F.lit(10.0), 3 - F.floor(F.log10("raw")))
    return s.select("symbol", (F.bround(F.col("raw") * digits) / digits).alias("size"))


def coarsen(bars: DataFrame, n: int) -> DataFrame:
    """n bars into one, by bar_id."""
    return bars.groupBy("symbol", F.floor(F.col("bar_id") / n).alias("bar_id")).agg(
        F.min("time").alias("time"), F.min_by("open", "bar_id").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_id").alias("close"), F.sum("volume").alias("volume"))
