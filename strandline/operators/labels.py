"""Exits and labels: barriers on closes or on highs and lows, trailing stops, horizon returns, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import in_reach


def close_barriers(events: DataFrame, bars: DataFrame, horizon: int, up: float, down: float, vol: str = "vol", side: int = 1) -> DataFrame:
    """Barriers at exp(+-k vol) of the close path: symbol, i0, i1 (exit bar), touch (up, down, expiry). A factor of 0 or less is no barrier.

    A touch in step 0 counts as none; an exit past the last bar is at the last bar.
    """
    p = in_reach(events, bars.select("symbol", "bar_id", F.col("close").alias("c")), 0, horizon)
    r = side * F.ln(F.col("c") / F.col("p0"))
    step = F.col("bar_id") - F.col("i0")
    hit = lambda cond: F.min(F.when(cond & (step > 0), step))
    tp = hit(r >= up * F.col(vol)) if up > 0 else F.lit(None).cast("long")
    sl = hit(r <= -down * F.col(vol)) if down > 0 else F.lit(None).cast("long")
    g = p.groupBy("symbol", "i0").agg(tp.alias("tp"), sl.alias("sl"), F.max("bar_id").alias("end"))
    exit_ = F.coalesce(F.least("tp", "sl"), F.lit(horizon))
    touch = F.when(F.col("tp") <= F.coalesce("sl", F.lit(horizon + 1)), "up").when(F.col("sl").isNotNull(), "down").otherwise("expiry")
    return g.select("symbol", "i0", F.least(F.col("i0") + exit_, "end").alias("i1"), touch.alias("touch"))


def range_barriers(events: DataFrame, bars: DataFrame, horizon: int, up: float, down: float, unit: str = "unit", side: int = 1, commission: float = 0.0) -> DataFrame:
    """Barriers `up` and `down` units above and below p0, looked for in highs and lows of the next `horizon` bars.

    Touches are strict. In one bar the upper comes before the lower and both before expiry. The exit is at the barrier's price, or at the
    close of bar i0 + horizon; where that is past the data the exit is null. ret = side * (exit / p0 - 1) - 2 commission.
    """
    p = in_reach(events, bars.select("symbol", "bar_id", "high", "low", "close"), -1, horizon)
    hi, lo = F.col("p0") + up * F.col(unit), F.col("p0") - down * F.col(unit)
    p = p.groupBy("symbol", "i0").agg(
        F.first("p0").alias("p0"), F.first(hi).alias("hi"), F.first(lo).alias("lo"), F.min(F.when(F.col("high") > hi, F.col("bar_id"))).alias("iu"), F.min(F.when(F.col("low") < lo, F.col("bar_id"))).alias("il"),
        F.max(F.when(F.col("bar_id") == F.col("i0") + horizon, F.col("close"))).alias("pe"))
    never = F.lit(2**62)
    iu, il = F.coalesce("iu", never), F.coalesce("il", never)
    touch = F.when((iu < never) & (iu <= il), "up").when(il < never, "down").when(F.col("pe").isNotNull(), "expiry")
    price = F.when(touch == "up", F.col("hi")).when(touch == "down", F.col("lo")).when(touch == "expiry", F.col("pe"))
    i1 = F.when(touch == "up", F.col("iu")).when(touch == "down", F.col("il")).when(touch == "expiry", F.col("i0") + horizon)
    return p.select("symbol", "i0", i1.alias("i1"), touch.alias("touch"), price.alias("p1"), (side * (price / F.col("p0") - 1) - 2 * commission).alias("ret"))


def trailing_stop(events: DataFrame, bars: DataFrame, horizon: int, stop: float, trigger: float, distance: float, vol: str = "vol") -> DataFrame:
    """Stop and trailing stop on the close path of `horizon` bars (the event's first): symbol, i0, i1, touch (stop, trail, expiry).

    Distances are |exp(-vol * d) - 1| of p0. The trail starts once the running maximum is `trigger` above p0 and lies `distance` below the maximum.
    """
    p = in_reach(events, bars.select("symbol", "bar_id", F.col("close").alias("c")), 0, horizon - 1)
    away = lambda d: F.abs(F.exp(-F.col(vol) * d) - 1) * F.col("p0")
    w = Window.partitionBy("symbol", "i0").orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("top", F.max("c").over(w))
    step = F.col("bar_id") - F.col("i0")
    sl = F.min(F.when((F.col("c") <= F.col("p0") - away(stop)) & (step > 0), step))
    tr = F.min(F.when((F.col("top") >= F.col("p0") + away(trigger)) & (F.col("c") <= F.col("top") - away(distance)) & (step > 0), step))
    g = p.groupBy("symbol", "i0").agg(sl.alias("sl"), tr.alias("tr"), F.max("bar_id").alias("end"))
    exit_ = F.coalesce(F.least("sl", "tr"), F.lit(horizon - 1))
    touch = F.when(F.col("sl") <= F.coalesce("tr", F.lit(horizon)), "stop").when(F.col("tr").isNotNull(), "trail").otherwise("expiry")
    return g.select("symbol", "i0", F.least(F.col("i0") + exit_, "end").alias("i1"), touch.alias("touch"))


def first_touch(events: DataFrame, bars: DataFrame, up: float, down: float, vol: str = "vol", longest: int = 10_000) -> DataFrame:
    """Simple returns on bars i0..i1 that first pass up * vol or fall under -down * vol; else i1. symbol, i0, iu, il, i1."""
    p = in_reach(events, bars.select("symbol", "bar_id", F.col("close").alias("c")), 0, longest).where(F.col("bar_id") <= F.col("i1"))
    r = F.col("c") / F.col("p0") - 1
    g = p.groupBy("symbol", "i0", "i1").agg(F.min(F.when(r > up * F.col(vol), F.col("bar_id"))).alias("iu"), F.min(F.when(r < -down * F.col(vol), F.col("bar_id"))).alias("il"))
    return g.select("symbol", "i0", "iu", "il", F.least("i1", "iu", "il").alias("i1"))


def bins(p0: Column, p1: Column, commission: float = 0.0, short: bool = False) -> tuple[Column, Column]:
    """Return and bin. The bin is that of the price change; a short's return has the other sign; two commissions are taken after."""
    ret = p1 / p0 - 1
    return (-ret if short else ret) - 2 * commission, F.signum(-ret if short else ret).cast("long")
