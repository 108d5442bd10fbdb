"""Signal tables: thresholds, grids of signals, time constraints, coarser candles, returns by horizon, and strategies made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import order


def thresholds(df: DataFrame, x: str, how: str, levels: Sequence[float], key: str = "symbol") -> DataFrame:
    """key, thr: the levels as they are, as standard scores of x, or as its percentiles (0..100)."""
    level = F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level")
    if how == "percentile":
        g = df.groupBy(key).agg(F.percentile(x, F.array(*[F.lit(v / 100) for v in levels])).alias("q"))
        return g.select(key, F.explode("q").alias("thr"))
    g = df.groupBy(key).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).select(key, "m", "s", level)
    return g.select(key, (F.col("m") + F.col("level") * F.col("s") if how == "zscore" else F.col("level")).alias("thr"))


def signal_grid(bars: DataFrame, x: str, levels: DataFrame, how: str, key: str = "symbol") -> DataFrame:
    """key, thr, bar_id, side of signals: `two_way` crosses a threshold either way, `one_way` upwards, `between` lies from one threshold to the next."""
    before = F.lag(x).over(order())
    b = bars.select(key, "bar_id", F.col(x).alias("x"), before.alias("before")).where("x is not null")
    if how == "between":
        lv = levels.withColumn("next", F.lead("thr").over(Window.partitionBy(key).orderBy("thr")))
        j = b.join(lv, key).where("x >= thr and (next is null or x < next)")
        return j.select(key, "thr", "bar_id", F.lit(1).alias("side"))
    j = b.join(levels, key)
    up, down = (F.col("x") >= F.col("thr")) & (F.col("before") < F.col("thr")), (F.col("x") <= F.col("thr")) & (F.col("before") > F.col("thr"))
    j = j.withColumn("side", F.when(up, 1).when(down, -1) if how == "two_way" else F.when(up, 1))
    return j.where("side is not null").select(key, "thr", "bar_id", "side")


def distinct_signals(signals: DataFrame, key: str = "symbol", name: str = "thr") -> DataFrame:
    """Without the columns of the grid that signal on the same bars as one of a smaller threshold: each is compared by a digest of its bars, which sums its rows' hashes."""
    h = F.xxhash64("bar_id", "side")
    d = signals.groupBy(key, name).agg(F.sum(h.cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n"))
    first = d.groupBy(key, "h", "n").agg(F.min(name).alias(name)).select(key, name)
    return signals.join(first, [key, name], "left_semi")


def time_allowed(time: str | Column, zone: str, days: Sequence[int] = (0, 1, 2, 3, 4), first: int = 8, last: int = 17) -> Column:
    """In zone, on one of the days (Monday is 0) and from hour `first` to before hour `last`; time has no zone and is UTC."""
    t = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(time) if isinstance(time, str) else time)
    return F.weekday(t).isin(*days) & (F.hour(t) >= first) & (F.hour(t) < last)


def resampled(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars of so many minutes of the clock."""
    w = F.window("time", f"{minutes} minutes")
    g = bars.groupBy("symbol", w.alias("w")).agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


def minutes_of(timeframe: str | Column) -> Column:
    """5m, 4h, 1d, 1w in minutes; null for others."""
    t = F.col(timeframe) if isinstance(timeframe, str) else timeframe
    unit = F.create_map(*[F.lit(x) for kv in {"m": 1, "h": 60, "d": 1440, "w": 10080}.items() for x in kv])
    return F.regexp_extract(t, "^([0-9]+)[mhdw]$", 1).try_cast("long") * F.element_at(unit, F.right(t, F.lit(1)))


def strided_zscore(x: str, n: int, stride: int) -> Column:
    """The standard score of x among its own value and those stride, 2 stride .. (n - 1) stride bars before: a coarser band without waiting for its candle."""
    values = F.array(*[F.lag(x, k * stride).over(order()) if k else F.col(x) for k in range(n)])
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    square = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return F.try_divide(F.col(x) - mean, F.sqrt(square / (n - 1)))


def return_grid(bars: DataFrame, horizons: Sequence[int], commission: float = 0.0) -> DataFrame:
    """symbol, bar_id, horizon, side, ret: returns of long and short positions held for each horizon, after two commissions."""
    ahead = bars.select("symbol", "bar_id", *[(F.lead("close", k).over(order()) / F.col("close") - 1).alias(f"r{k}") for k in horizons])
    h = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.col(f"r{k}").alias("r")) for k in horizons])).alias("h")
    r = ahead.select("symbol", "bar_id", h).where("h.r is not null")
    return r.select("symbol", "bar_id", "h.horizon", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"), F.col("h.r").alias("r")).select("symbol", "bar_id", "horizon", "side", (F.col("side") * F.col("r") - 2 * commission).alias("ret"))
