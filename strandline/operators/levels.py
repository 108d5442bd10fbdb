"""Supports and resistances: pivots of closes, distances of the nearest, the ratio of binned levels, peaks and troughs by prominence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import between, div, gate, roll

from .paths import in_reach

KEYS = ("symbol", "i0")


def pivots(bars: DataFrame, n: int) -> DataFrame:
    """Bars with `low` and `high` flags: closes not above (not below) the n closes before and the n after, all of which must be there."""
    edge = lambda f, a, b: gate(f("close").over(between(a, b)), "close", n, between(a, b))
    low = (edge(F.min, -n, -1) >= F.col("close")) & (edge(F.min, 1, n) >= F.col("close"))
    high = (edge(F.max, -n, -1) <= F.col("close")) & (edge(F.max, 1, n) <= F.col("close"))
    return bars.select("symbol", "bar_id", "close", F.coalesce(low, F.lit(False)).alias("is_low"), F.coalesce(high, F.lit(False)).alias("is_high"))


def nearest_levels(events: DataFrame, bars: DataFrame, back: int, nearest: int, confirm: int, below: bool = True, both: bool = False, norm: bool = False) -> DataFrame:
    """events(symbol, i0, p0) -> symbol, i0, value: |ln(mean of the nearest pivots below (or above) p0 / p0)|, of those from `back` bars before to `confirm` bars before.

    Pivots below are lows and those above are highs, or lows and highs alike (`both`). `norm`: in units of the sample deviation of the last `back` log
    closes, null where these aren't all there.
    """
    flag = "is_low or is_high" if both else "is_low" if below else "is_high"
    p = in_reach(events.select("symbol", "i0", "p0"), pivots(bars, confirm).where(flag).select("symbol", "bar_id", "close"), back, -confirm)
    p = p.where(F.col("close") < F.col("p0") if below else F.col("close") > F.col("p0"))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("close") if below else F.asc("close"), "bar_id"))
    g = p.withColumn("n", rank).where(F.col("n") <= nearest).groupBy(*KEYS, "p0").agg(F.avg("close").alias("m"))
    value = F.abs(F.ln(F.col("m") / F.col("p0")))
    if not norm:
        return g.select(*KEYS, value.alias("value"))
    sd = bars.select("symbol", F.col("bar_id").alias("i0"), roll(F.stddev_samp, F.ln("close"), back).alias("_sd"))
    return g.join(sd, list(KEYS)).select(*KEYS, div(value, F.col("_sd")).alias("value"))


def level_bins(levels: list[float], groups: int, size: float = 0.5, fill: float = 8.0) -> list[float]:
    """Means of greedy bins: a level joins the bin while it is within `size` of the bin's first; the bin still open is not closed; padded with fill."""
    out, held = [], []
    for x in levels:
        if held and abs(x - held[0]) > size:
            out.append(sum(held) / len(held))
            held = []
            if len(out) == groups:
                return out
        held.append(x)
    return out + [fill] * (groups - len(out))


def level_ratio(events: DataFrame, bars: DataFrame, deviations: DataFrame, back: int, confirm: int, groups: int = 2) -> DataFrame:
    """Ratio of the mean resistance to the mean support: pivots walked back from the event, as log distances in units of the path's
    deviation (deviations: symbol, i0, value), those over 0.5 that set a new extreme, in bins. symbol, i0, value. Pivots older than `back` bars don't count."""
    p = in_reach(events.select("symbol", "i0", "p0"), pivots(bars, confirm).where("is_low or is_high").select("symbol", "bar_id", "close"), back, -confirm)
    p = p.join(deviations.withColumnRenamed("value", "_d"), list(KEYS)).withColumn("z", F.ln(F.col("close") / F.col("p0")) / F.col("_d"))
    g = p.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("bar_id")).alias("k"), "z"))), lambda s: s["z"]).alias("z"))

    @F.pandas_udf("double")
    def ratio(zs: pd.Series) -> pd.Series:
        out = []
        for z in zs:
            z = np.asarray(z, float)
            up, down = z[z > 0.5], z[z < -0.5]
            up = up[up == np.maximum.accumulate(up)] if len(up) else up
            down = down[down == np.minimum.accumulate(down)] if len(down) else down
            r, s = level_bins(up.tolist(), groups), level_bins(down.tolist(), groups)
            out.append(abs(np.mean(r) / np.mean(s)))
        return pd.Series(out, dtype=float)

    return g.select(*KEYS, ratio("z").alias("value"))


def prominent(y: np.ndarray, least: float) -> np.ndarray:
    """Places of local maxima (the middle of plateaus) whose prominence is at least `least`: height over the higher of the two lowest points between it and a higher one or the end."""
    out, i = [], 1
    while i < len(y) - 1:
        if y[i - 1] < y[i]:
            j = i
            while j < len(y) - 1 and y[j + 1] == y[i]:
                j += 1
            if j < len(y) - 1 and y[j + 1] < y[i]:
                at = (i + j) // 2
                higher = np.nonzero(y > y[at])[0]
                left = higher[higher < at].max(initial=-1) + 1
                right = higher[higher > at].min(initial=len(y))
                if y[at] - max(y[left : at + 1].min(), y[at:right].min()) >= least:
                    out.append(at)
            i = j
        i += 1
    return np.array(out, int)


def between_levels(p: DataFrame, prominence: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """paths(keys, step, value) -> keys, value: where the last value lies between the path's lowest prominent trough (0) and its highest prominent peak (1)."""
    g = p.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda s: s["value"]).alias("y"))

    @F.pandas_udf("double")
    def scaled(ys: pd.Series) -> pd.Series:
        out = []
        for y in ys:
            y = np.asarray([v for v in y if v is not None], float)
            peak, trough = prominent(y, prominence), prominent(-y, prominence)
            out.append((y[-1] - y[trough].min()) / (y[peak].max() - y[trough].min()) if len(peak) and len(trough) else None)
        return pd.Series(out, dtype=float)

    return g.select(*keys, F.nanvl(scaled("y"), F.lit(None)).alias("value"))
