"""Signal counts of every threshold at once, and the threshold that gives a wanted number of signals.

A series crosses upwards, from one bar to the next, exactly the thresholds of an interval that is open below and closed above: those over the
value before, up to the value now. A signal counts if no bar of the `distance` before it crossed the same threshold, so what is left of a bar's interval
after those of the bars before are taken out are the thresholds at which it counts. One sweep over the ends of what is left, from the top, gives the
number of signals of every threshold: no grid, and a search is a lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import order


def _without(parts: Column, gone: Column) -> Column:
    """Intervals (lo, hi] without another one."""
    left = lambda p: F.struct(p["lo"].alias("lo"), F.least(p["hi"], gone["lo"]).alias("hi"))
    right = lambda p: F.struct(F.greatest(p["lo"], gone["hi"]).alias("lo"), p["hi"].alias("hi"))
    return F.filter(F.flatten(F.transform(parts, lambda p: F.array(left(p), right(p)))), lambda p: p["hi"] > p["lo"])


def signal_intervals(bars: DataFrame, x: str, distance: int = 3) -> DataFrame:
    """symbol, bar_id, lo, hi: the thresholds (lo, hi] at whose upward crossing the bar is a signal. Bars with fewer than `distance` bars before them are none; a null value crosses nothing."""
    before = F.lag(x).over(order())
    b = bars.select("symbol", "bar_id", F.col(x).cast("double").alias("hi"), before.cast("double").alias("lo"))
    b = b.withColumn("own", F.when(F.col("hi") > F.col("lo"), F.struct("lo", "hi")))
    earlier = F.array_compact(F.array(*[F.lag("own", k).over(order()) for k in range(1, distance + 1)])) if distance else F.array().cast("array<struct<lo:double,hi:double>>")
    enough = F.lag(F.lit(1), distance).over(order()).isNotNull() if distance else F.lit(True)
    b = b.withColumn("earlier", earlier).withColumn("enough", enough).where("own is not null and enough")
    parts = F.aggregate("earlier", F.array("own"), _without)
    return b.select("symbol", "bar_id", F.explode(parts).alias("p")).select("symbol", "bar_id", "p.lo", "p.hi")


def signal_counts(bars: DataFrame, x: str, distance: int = 3) -> DataFrame:
    """symbol, threshold, signals: for every value of x the number of signals at it, which is that of all thresholds down to the next smaller value."""
    iv = signal_intervals(bars, x, distance)
    ends = iv.select("symbol", F.explode(F.array(F.struct(F.col("hi").alias("threshold"), F.lit(1).alias("d")), F.struct(F.col("lo").alias("threshold"), F.lit(-1).alias("d")))).alias("e")).select("symbol", "e.*")
    values = bars.where(F.col(x).isNotNull()).select("symbol", F.col(x).cast("double").alias("threshold"), F.lit(0).alias("d"))
    sums = ends.unionByName(values).groupBy("symbol", "threshold").agg(F.sum("d").alias("d"))
    return sums.select("symbol", "threshold", F.sum("d").over(Window.partitionBy("symbol").orderBy(F.desc("threshold"))).cast("long").alias("signals"))


def find_threshold(bars: DataFrame, x: str, per_month: float, lower: bool = False, distance: int = 3) -> DataFrame:
    """symbol, threshold, signals, target: of the values of x at or beyond its median the one whose number of signals is nearest to per_month times the months (of 30 days) that the bars span; of equals the nearest to the median.

    Upward crossings at or above the median; `lower`: downward ones at or below it. Symbols without a value of x, or with one day at most, are not listed.
    """
    sign = -1.0 if lower else 1.0
    signed = bars.select("symbol", "bar_id", "time", (F.col(x) * sign).alias("x"))
    days = F.floor((F.unix_micros(F.max("time").cast("timestamp")) - F.unix_micros(F.min("time").cast("timestamp"))) / 86400e6)
    about = signed.groupBy("symbol").agg((days / 30 * per_month).alias("target"), F.percentile("x", F.lit(0.5)).alias("median")).where("target > 0")
    near = signal_counts(signed, "x", distance).join(about, "symbol").where("threshold >= median")
    off = F.round(F.abs(F.col("signals") - F.col("target")), 9)
    best = near.groupBy("symbol", "target").agg(F.min(F.struct(off.alias("off"), "threshold", "signals")).alias("b"))
    return best.select("symbol", (F.col("b.threshold") * sign).alias("threshold"), "b.signals", "target")
