"""Weights of overlapping events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import prefix


def uniqueness(events: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, i0, i1, weight: the mean over bars i0..i1 of one over the number of events that hold the bar.

    A sweep of starts and ends gives the number, its inverse is summed up, and an event takes the difference of two
    sums, so events are never spread over their bars. i0 is unique for each symbol; events past the last bar end there.
    """
    last = bars.groupBy("symbol").agg(F.max("bar_id").alias("_last"))
    e = events.join(last, "symbol").withColumn("i1", F.least("i1", "_last")).select("symbol", "i0", "i1")
    step = e.select("symbol", F.col("i0").alias("bar_id"), F.lit(1).alias("d")).unionByName(e.select("symbol", (F.col("i1") + 1).alias("bar_id"), F.lit(-1).alias("d")))
    step = step.groupBy("symbol", "bar_id").agg(F.sum("d").alias("d"))
    held = bars.select("symbol", "bar_id").join(step, ["symbol", "bar_id"], "left").withColumn("held", F.sum(F.coalesce("d", F.lit(0))).over(prefix()))
    inverse = F.when(F.col("held") > 0, 1.0 / F.col("held")).otherwise(0.0)
    sums = held.withColumn("inv", inverse).withColumn("s", F.sum("inv").over(prefix()))
    a = sums.select("symbol", F.col("bar_id").alias("i0"), (F.col("s") - F.col("inv")).alias("s0"))
    b = sums.select("symbol", F.col("bar_id").alias("i1"), F.col("s").alias("s1"))
    out = e.join(a, ["symbol", "i0"]).join(b, ["symbol", "i1"])
    return out.select("symbol", "i0", "i1", ((F.col("s1") - F.col("s0")) / (F.col("i1") - F.col("i0") + 1)).alias("weight"))


def time_decay(weighted: DataFrame, oldest: float = 0.5) -> DataFrame:
    """Adds decay: linear in the running sum of weights, 1 at the newest event; `oldest` at the start if it is 0 or more, else 0 for that share."""
    w = Window.partitionBy("symbol").orderBy("i0").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("weight").over(Window.partitionBy("symbol"))
    slope = (1 - oldest) / total if oldest >= 0 else 1 / ((oldest + 1) * total)
    return weighted.withColumn("decay", F.greatest(1 - slope * total + slope * F.sum("weight").over(w), F.lit(0.0)))
