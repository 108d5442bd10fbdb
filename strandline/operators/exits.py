"""More exits and labels: trailing stops on a finer path, absolute widths, per-event expiry, label wrappers, pair legs and event studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import bins
from .paths import as_of, in_reach

_NEVER = 2**62


def trailing_barriers(events: DataFrame, fine: DataFrame, factor: int, up: float, down: float, expiry: int, activation: float, distance: float, unit: str = "unit", side: int = 1) -> DataFrame:
    """Barriers and a trailing stop looked for on a finer series, `factor` bars of which are one bar of the events.

    events: symbol, i0 (bar), p0, unit. The path is the fine bars after the end of bar i0, up to the end of bar i0 + expiry.
    The stop is active once the running extreme (the same bar's included) is `activation` units beyond p0 and lies
    `distance` units from it. In one bar the upper barrier comes first, then the lower, expiry and the trail. Returns symbol, i0,
    j1 (fine bar), touch and p1; ret = side * (p1 / p0 - 1).
    """
    e = events.select("symbol", "i0", "p0", F.col(unit).alias("_u"), ((F.col("i0") + 1) * factor - 1).alias("_j0"))
    p = in_reach(e, fine.select("symbol", "bar_id", "high", "low", "close"), -1, expiry * factor, "_j0")
    w = Window.partitionBy("symbol", "i0").orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    hi, lo = F.col("p0") + up * F.col("_u"), F.col("p0") - down * F.col("_u")
    if side > 0:
        top = F.max("high").over(w)
        stop, active, cross = top - distance * F.col("_u"), top >= F.col("p0") + activation * F.col("_u"), lambda s: F.col("low") <= s
    else:
        top = F.min("low").over(w)
        stop, active, cross = top + distance * F.col("_u"), top <= F.col("p0") - activation * F.col("_u"), lambda s: F.col("high") >= s
    p = p.withColumn("_stop", F.when(active, stop))
    first = lambda c: F.coalesce(F.min(F.when(c, F.col("bar_id"))), F.lit(_NEVER))
    g = p.groupBy("symbol", "i0", "p0", "_u", "_j0").agg(
        first(F.col("high") > hi).alias("ju"), first(F.col("low") < lo).alias("jl"), first(cross(F.col("_stop"))).alias("jt"),
        F.min_by("_stop", F.when(cross(F.col("_stop")), F.col("bar_id"))).alias("stop"), F.max_by("close", F.when(F.col("bar_id") == F.col("_j0") + expiry * factor, 1)).alias("pe"))
    je = F.when(F.col("pe").isNotNull(), F.col("_j0") + expiry * factor).otherwise(_NEVER)
    j1 = F.least("ju", "jl", "jt", je)
    touch = F.when(j1 == _NEVER, None).when(j1 == F.col("ju"), "up").when(j1 == F.col("jl"), "down").when(j1 == je, "expiry").otherwise("trail")
    price = F.when(touch == "up", hi).when(touch == "down", lo).when(touch == "expiry", F.col("pe")).when(touch == "trail", F.col("stop"))
    return g.select("symbol", "i0", F.when(j1 < _NEVER, j1).alias("j1"), touch.alias("touch"), price.alias("p1"), (side * (price / F.col("p0") - 1)).alias("ret"))


def trailing_to(events: DataFrame, bars: DataFrame, stop: float, trigger: float, distance: float, longest: int, vol: str = "vol", side: int = 1) -> DataFrame:
    """Stop and trailing stop on closes from bar i0 to the event's own bar i1 (at most `longest` later): symbol, i0, i1.

    A touch in the first bar counts as none; without a touch the exit is the last bar of the path.
    """
    p = in_reach(events, bars.select("symbol", "bar_id", F.col("close").alias("c")), 0, longest).where(F.col("bar_id") <= F.col("i1"))
    w = Window.partitionBy("symbol", "i0").orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    v, p0 = F.col(vol), F.col("p0")
    away = F.abs(F.exp(-v * distance) - 1) * p0
    if side > 0:
        top = F.max("c").over(w)
        hit = F.col("c") <= F.exp(-v * stop) * p0
        trail = (top >= F.exp(v * trigger) * p0) & (top - F.col("c") >= away)
    else:
        top = F.min("c").over(w)
        hit = F.col("c") >= F.exp(v * stop) * p0
        trail = (top <= F.exp(-v * trigger) * p0) & (F.col("c") - top >= away)
    p = p.withColumn("_hit", (hit | trail) & (F.col("bar_id") > F.col("i0")))
    return p.groupBy("symbol", "i0").agg(F.coalesce(F.min(F.when(F.col("_hit"), F.col("bar_id"))), F.max("bar_id")).alias("i1"))


def labelled(events: DataFrame, bars: DataFrame, hold: int, commission: float = 0.0, short: bool = False) -> DataFrame:
    """Events (symbol, i0) held for `hold` bars: i1, p0, p1, ret, bin. Those that end past the data go."""
    p = bars.select("symbol", "bar_id", "close")
    e = events.select("symbol", "i0", (F.col("i0") + hold).alias("i1"))
    e = e.join(p.select("symbol", F.col("bar_id").alias("i0"), F.col("close").alias("p0")), ["symbol", "i0"]).join(p.select("symbol", F.col("bar_id").alias("i1"), F.col("close").alias("p1")), ["symbol", "i1"])
    ret, bin_ = bins(F.col("p0"), F.col("p1"), commission, short)
    return e.select("symbol", "i0", "i1", "p0", "p1", ret.alias("ret"), bin_.alias("bin"))


def log_return(p0: Column, p1: Column, commission: float, size: Column | float = 1.0, short: bool = False) -> Column:
    """Of one leg of a trade: long ln(1 + (p1/p0 - c - 1) b), short ln(1 + (1 - p1/p0 - c) b)."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.log1p(((1 - p1 / p0) if short else (p1 / p0 - 1)) * size - commission * size)


def levered(lret: Column, vol: Column, target: float | None = None, most: float | None = None) -> Column:
    """A log return at target volatility, or with volatility capped at `most`: the simple return over vol / target (at least 1 for the cap)."""
    if target is not None:
        ratio = vol / target
    elif most is not None:
        ratio = F.greatest(vol / most, F.lit(1.0))
    else:
        return lret
    return F.log1p(F.expm1(lret) / ratio)


def event_returns(events: DataFrame, bars: DataFrame, holds: list[int], digits: int = 3) -> DataFrame:
    """Event study: symbol, time, hold, ret, low, high. The entry is the open of the last bar before the event; each hold of so many
    bars gives the close at its end, and the least low and greatest high after the entry bar, in relation to the entry, rounded half to even."""
    e = as_of(events, bars.select("symbol", "time", "bar_id", "open"), strict=True).where("bar_id_r is not null")
    e = e.select("symbol", "time", F.col("bar_id_r").alias("i0"), F.col("open_r").alias("p0"))
    p = in_reach(e, bars.select("symbol", "bar_id", "close", "high", "low"), -1, max(holds)).withColumn("step", F.col("bar_id") - F.col("i0"))
    p = p.withColumn("hold", F.explode(F.array(*map(F.lit, holds)))).where("step <= hold")
    g = p.groupBy("symbol", "time", "i0", "p0", "hold").agg(F.max(F.when(F.col("step") == F.col("hold"), F.col("close"))).alias("c"), F.min("low").alias("lo"), F.max("high").alias("hi"))
    r = lambda c: F.bround(F.col(c) / F.col("p0") - 1, digits)
    return g.where("c is not null").select("symbol", "time", "hold", r("c").alias("ret"), r("lo").alias("low"), r("hi").alias("high"))


def announced_returns(events: DataFrame, bars: DataFrame, most: str = "interval 24 hours") -> DataFrame:
    """events(symbol, announced, start) -> the return from the bar at the announcement, but not earlier than `most` before the start, to the bar at the start."""
    t0 = F.greatest(F.col("announced"), F.col("start") - F.expr(most))
    e = as_of(events.select("symbol", "announced", "start", t0.alias("time")), bars.select("symbol", "time", "close"))
    e = e.select("symbol", "announced", F.col("close_r").alias("p0"), F.col("start").alias("time"))
    e = as_of(e, bars.select("symbol", "time", "close"))
    return e.select("symbol", "announced", F.col("time").alias("start"), (F.col("close_r") / F.col("p0") - 1).alias("ret")).where("ret is not null")
