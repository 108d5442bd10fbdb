"""Feature-utility grids: for each threshold of a grid the whole study, keyed by threshold, in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.windows import lag

from strandline.sources.scratch import cut

from .events import cusum_events, non_overlapping, paired_trades
from .labels import first_touch
from .weights import uniqueness

KEYS = ("symbol", "thr")


def on_grid(bars: DataFrame, feature: str, thresholds: Sequence[float]) -> DataFrame:
    """Bars with the feature's value before, once for each threshold (a few literals: no join)."""
    return bars.withColumn("_before", lag(feature)).withColumn("thr", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))


def crosses(feature: str, level: Column, up: bool) -> Column:
    now, before = F.col(feature), F.col("_before")
    return F.coalesce((now >= level) & (before < level) if up else (now <= level) & (before > level), F.lit(False))


def entries(bars: DataFrame, feature: str, thresholds: Sequence[float], crossing: str = "up", mid: float = 0.0) -> DataFrame:
    """Crossings of each threshold: symbol, thr, t0, i0, p0. `outward` is upward from mid on and downward below it."""
    g = on_grid(bars, feature, thresholds)
    hit = crosses(feature, F.col("thr"), crossing != "down")
    if crossing == "outward":
        hit = F.when(F.col("thr") >= mid, crosses(feature, F.col("thr"), True)).otherwise(crosses(feature, F.col("thr"), False))
    keep = [c for c in ("vol",) if c in bars.columns]
    return g.where(hit).select(*KEYS, F.col("time").alias("t0"), F.col("bar_id").alias("i0"), F.col("close").alias("p0"), *keep)


def at_exit(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds t1 and p1 of bar i1."""
    b = bars.select("symbol", F.col("bar_id").alias("i1"), F.col("time").alias("t1"), F.col("close").alias("p1"))
    return events.join(b, ["symbol", "i1"])


def summed_up(trades: DataFrame, data_days: float, trading_days: float = 365.0, keep_zero: bool = False, least_days: int = 5) -> DataFrame:
    """trades(symbol, thr, t0, t1, lret) -> a row for each threshold with more than `least_days` days: utility, sharpe, annual, zscore, freq, hours, sharpe_freq.

    Days are those of the entry. keep_zero counts days without a trade between the first and the last as well.
    """
    year = trading_days / data_days
    r = trades.groupBy(*KEYS).agg(F.avg("lret").alias("m"), F.stddev_samp("lret").alias("s"), F.count(F.lit(1)).alias("n"), F.median((F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 3.6e9).alias("hours"))
    d = trades.groupBy(*KEYS, F.to_date("t0").alias("day")).agg(F.sum("lret").alias("r"))
    days = F.date_diff(F.max("day"), F.min("day")) + 1 if keep_zero else F.count(F.lit(1))
    d = (d if keep_zero else d.where("r <> 0")).groupBy(*KEYS).agg(F.sum("r").alias("total"), F.sum(F.col("r") * F.col("r")).alias("square"), days.alias("days"))
    sharpe = F.try_divide(F.col("total"), F.sqrt("square")) * year**0.5
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(6.0), F.col("sharpe")))
    out = d.where(F.col("days") > least_days).join(r, list(KEYS)).withColumn("sharpe", sharpe)
    return out.select(
        *KEYS, (F.col("total") * clipped * year).alias("utility"), "sharpe", (F.col("total") * year).alias("annual"), (F.try_divide(F.col("m"), F.col("s")) * F.sqrt(F.col("n").cast("double"))).alias("zscore"),
        (F.col("n") * year).alias("freq"), "hours", (F.col("n") * year * clipped).alias("sharpe_freq"))


def utility_grid(bars: DataFrame, feature: str, thresholds: Sequence[float], hold: int, data_days: float, crossing: str = "up", side: int = 1, leverage: float = 1.0, commission: float = 0.001, extra: float = 0.0, exits: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each threshold's crossings, held `hold` bars (at most to the last) or to what `exits` gives (symbol, i0, i1), without overlap, summed up.

    A trade's return is ((side * (p1 / p0 - 1)) - commission) * leverage - extra, as a log return.
    """
    e = entries(bars, feature, thresholds, crossing)
    if exits is None:
        last = bars.groupBy("symbol").agg(F.max("bar_id").alias("_last"))
        e = e.join(F.broadcast(last) if last.limit(1001).count() <= 1000 else last, "symbol").withColumn("i1", F.least(F.col("i0") + hold, F.col("_last"))).drop("_last")
    else:
        e = e.join(exits(e.drop("thr").dropDuplicates(["symbol", "i0"])), ["symbol", "i0"])
    t = at_exit(non_overlapping(e, "i0", "i1", KEYS), bars)
    ret = (side * (F.col("p1") / F.col("p0") - 1) - commission) * leverage - extra
    return summed_up(t.withColumn("lret", F.log1p(ret)), data_days)


def dynamic_exits(bars: DataFrame, feature: str, thresholds: Sequence[float], exit_level: float, entry_up: bool, exit_up: bool) -> DataFrame:
    """Entries at each threshold, each with the next crossing of exit_level: symbol, thr, t0, i0, t1, i1."""
    g = on_grid(bars, feature, thresholds)
    return paired_trades(g, crosses(feature, F.col("thr"), entry_up), crosses(feature, F.lit(exit_level), exit_up), KEYS)


def sampling_grid(bars: DataFrame, vol: str, params: Sequence[dict[str, float]], cost: float = 0.001) -> DataFrame:
    """symbol, h_mul, hold, barrier, n, uniqueness, abs_ret, score of every parameter set over the sampling pipeline, in one plan.

    Each set is a part of the key, so all of them go through the same reset filter (limit h_mul * vol), first touches (barrier * vol on both sides,
    `hold` bars at most) and uniqueness weights; the score is mean uniqueness * (mean absolute return - cost) * events. Sets are few, as bars are repeated
    for each; bars of null vol make no event; bars(symbol, time, bar_id, close).
    """
    sets = F.array(*[F.struct(F.lit(k).alias("set"), *[F.lit(float(p[c])).alias(c) for c in ("h_mul", "hold", "barrier")]) for k, p in enumerate(params)])
    keyed = bars.select("symbol", "time", "bar_id", "close", F.col(vol).alias("vol"), F.explode(sets).alias("p")).select("*", "p.*")
    keyed = keyed.withColumn("symbol", F.concat_ws("|", "set", "symbol"))
    ready = keyed.withColumn("x", F.ln("close")).withColumn("h", F.col("h_mul") * F.col("vol"))
    i0 = cusum_events(ready, "x", "h").select("symbol", F.col("bar_id").alias("i0")).distinct()
    at = keyed.select("symbol", F.col("bar_id").alias("i0"), F.col("close").alias("p0"), (F.col("vol") * F.col("barrier")).alias("vol"), (F.col("bar_id") + F.col("hold").cast("long")).alias("i1"))
    events = cut(i0.join(at, ["symbol", "i0"]))
    touched = first_touch(events, keyed, 1.0, 1.0, longest=int(max(p["hold"] for p in params)))
    weighted = uniqueness(touched.select("symbol", "i0", "i1"), keyed)
    ends = keyed.select("symbol", F.col("bar_id").alias("i1"), F.col("close").alias("p1"))
    out = weighted.join(events.select("symbol", "i0", "p0"), ["symbol", "i0"]).join(ends, ["symbol", "i1"])
    g = out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("uniqueness"), F.avg(F.abs(F.col("p1") / F.col("p0") - 1)).alias("abs_ret"))
    g = g.withColumn("score", F.col("uniqueness") * (F.col("abs_ret") - cost) * F.col("n"))
    parts = F.split("symbol", r"\|", 2)
    g = g.withColumn("p", F.element_at(sets, (parts[0].cast("int") + 1))).withColumn("symbol", parts[1])
    return g.select("symbol", "p.h_mul", "p.hold", "p.barrier", "n", "uniqueness", "abs_ret", "score")
