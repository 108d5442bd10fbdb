"""Event sampling: crossings, entry and exit pairing, cumulative-sum filters and the thinning of overlapping events."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import between, order
from strandline.sources.scratch import cut

from .blocks import before_blocks, sized


def crossed(x: str, level: Column | float, up: bool) -> Column:
    """x is at or beyond level now and was short of it in the bar before. False where either is null."""
    now, before, level = F.col(x), F.lag(x).over(order()), level if isinstance(level, Column) else F.lit(level)
    hit = (now >= level) & (before < level) if up else (now <= level) & (before > level)
    return F.coalesce(hit, F.lit(False))


def crossings(bars: DataFrame, x: str, level: float, up: bool, vol: str | None = None, min_vol: float | None = None) -> DataFrame:
    """Bars at which x crosses level. Bars of less volatility than min_vol go; those where it is null stay."""
    out = bars.withColumn("_hit", crossed(x, level, up)).where("_hit").drop("_hit")
    return out if vol is None else out.where(~F.coalesce(F.col(vol) < min_vol, F.lit(False)))


def paired_trades(bars: DataFrame, entry: Column, exit_: Column, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Entry bars, each with the next exit: keys, t0, i0, t1, i1.

    The union of entries and exits in order; of a run of the same type the first counts; leading exits and a trailing entry go.
    An entry and an exit of the same bar come in this order.
    """
    e = bars.select(*keys, "time", "bar_id", entry.alias("_in"), exit_.alias("_out")).where("_in or _out")
    e = e.withColumn("kind", F.explode(F.array_compact(F.array(F.when(F.col("_in"), 0), F.when(F.col("_out"), 1)))))
    w = Window.partitionBy(*keys).orderBy("bar_id", "kind")
    e = e.withColumn("before", F.lag("kind").over(w)).where("before is null or before <> kind")
    e = e.withColumn("t1", F.lead("time").over(w)).withColumn("i1", F.lead("bar_id").over(w))
    return e.where("kind = 0 and t1 is not null").select(*keys, F.col("time").alias("t0"), F.col("bar_id").alias("i0"), "t1", "i1")


def sum_exits(steps: np.ndarray, limits: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """What a block of rows makes of every state s >= 0 that it may be entered with, for s = max(0, s + step), back to 0 beyond the limit.

    States up to each of `tops` (rising) leave with the state in `leave`; where `kept` is 1 that is added to s, as these have met neither 0 nor a
    limit. Entries that have met one are in few states from then on, and those in one state stay together.
    """
    low, high, run = -1.0, math.inf, 0.0  # entries in (low, high] have met nothing so far
    classes: dict[float, list[float]] = {}  # state -> upper ends of the intervals of entries in it
    for step, limit in zip(steps.tolist(), limits.tolist()):
        moved: dict[float, list[float]] = {}
        for s, tops in classes.items():
            s = max(0.0, s + step)
            moved.setdefault(0.0 if s > limit else s, []).extend(tops)
        classes = moved
        if low < high:
            run += step
            if math.isnan(run):
                classes.setdefault(0.0, []).append(high)
                low = high
                continue
            if -run > low:
                low = min(-run, high)
                classes.setdefault(0.0, []).append(low)
            if limit - run < high and low < high:
                classes.setdefault(0.0, []).append(high)
                high = max(limit - run, low)
    rows = [(top, s, 0.0) for s, tops in classes.items() for top in tops] + ([(high, run, 1.0)] if low < high else [])
    tops, leave, kept = (list(x) for x in zip(*sorted(rows))) if rows else ([math.inf], [0.0], [1.0])
    return tops, leave, kept


def cusum_events(bars: DataFrame, x: str, threshold: str, use_pos: bool = True, use_neg: bool = True, block: int = 4096) -> DataFrame:
    """symbol, time, bar_id, side of the bars at which the running sum of changes of x leaves (-h, h); it then starts anew.

    No task holds a symbol's history: rows are in blocks of `block` bar numbers; each is summed up as a map from the state it may be entered with
    to the state it leaves (sum_exits), the maps are composed in order, a few numbers for each block, and then each block is walked once from its entry.

    A null threshold makes no event but the sums go on. A null x sets both sums to 0, at its own bar and at the next, whose changes are
    null. The lower side is looked at first.
    """
    types = {f.name: f.dataType.simpleString() for f in bars.schema}
    own = bars.select("symbol", "time", "bar_id", F.col(x).cast("double").alias("x"), F.col(threshold).cast("double").alias("h"), F.floor(F.col("bar_id") / block).alias("_b"))
    own = before_blocks(own, ["symbol"], "_b", lasts={"_was": (F.struct("x"), F.col("bar_id"))})
    own = cut(own.select("symbol", "time", "bar_id", "x", "h", "_b", F.col("_was.x").alias("was"), F.col("_was").isNotNull().alias("goes_on")))

    def changes(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """Rows that have one before them, their changes and limits."""
        pdf = pdf.sort_values("bar_id", ignore_index=True)
        v = pdf["x"].to_numpy(float)
        d = v - np.concatenate([pdf["was"].to_numpy(float)[:1], v[:-1]])
        k = 0 if pdf["goes_on"].iloc[0] else 1
        return pdf.iloc[k:], d[k:], pdf["h"].to_numpy(float)[k:]

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        _, d, h = changes(pdf)
        rows = [(pdf["symbol"].iloc[0], pdf["_b"].iloc[0], side, *sum_exits(side * d, h)) for side in (1, -1)]
        return pd.DataFrame(rows, columns=["symbol", "_b", "side", "tops", "leave", "kept"])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = {1: 0.0, -1: 0.0}, {}
        for b, side, tops, leave, kept in pdf.sort_values("_b")[["_b", "side", "tops", "leave", "kept"]].itertuples(index=False):
            s = state[side]
            out.setdefault(b, {})[side] = s
            k = int(np.searchsorted(tops, s))
            state[side] = leave[k] + (s if kept[k] else 0.0)
        return pd.DataFrame([(pdf["symbol"].iloc[0], b, x[1], x[-1]) for b, x in out.items()], columns=["symbol", "_b", "up", "down"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        hi, lo = float(pdf["up"].iloc[0]), -float(pdf["down"].iloc[0])
        pdf, d, h = changes(pdf)
        at, side = [], []
        for i, (step, limit) in enumerate(zip(d.tolist(), h.tolist())):
            hi, lo = max(0.0, hi + step), min(0.0, lo + step)
            if lo < -limit:
                lo = 0.0
                at.append(i)
                side.append(-1)
            if hi > limit:
                hi = 0.0
                at.append(i)
                side.append(1)
        return pdf.iloc[at][["symbol", "time", "bar_id"]].assign(side=side)

    key = f"symbol {types['symbol']}"
    if own.where("goes_on").where(F.col("_b") > 0).take(1):
        maps = own.groupBy("symbol", "_b").applyInPandas(summed, f"{key}, _b long, side long, tops array<double>, leave array<double>, kept array<double>")
        entries = cut(maps.groupBy("symbol").applyInPandas(composed, f"{key}, _b long, up double, down double"))
        own = own.join(sized(entries), ["symbol", "_b"])
    else:
        own = own.withColumns({"up": F.lit(0.0), "down": F.lit(0.0)})
    out = own.groupBy("symbol", "_b").applyInPandas(walk, f"{key}, time {types['time']}, bar_id long, side long")
    return out.where(F.lit(use_pos) & (F.col("side") > 0) | F.lit(use_neg) & (F.col("side") < 0))


def refractory(bars: DataFrame, signal: Column, distance: int) -> DataFrame:
    """Signals with no raw signal in the `distance` bars before, all of which must be there."""
    b = bars.withColumn("_s", F.coalesce(signal, F.lit(False)).cast("int"))
    quiet = (F.sum("_s").over(between(-distance, -1)) == 0) & (F.count("_s").over(between(-distance, -1)) == distance)
    return b.withColumn("_q", quiet).where("_s = 1 and _q").drop("_s", "_q")


def non_overlapping(events: DataFrame, start: str, end: str, keys: tuple[str, ...] = ("symbol",), block: int = 4096) -> DataFrame:
    """Greedy: keep the first event, drop those that start before it ends, and so on. An event that starts when one ends stays.

    The kept events are the orbit of `next`: the first later event whose start is not before the end. Events are dealt into blocks of
    `block` in the order of their starts; one of no length is followed by the next start. In each block a grouped function tells for every event where a walk from it leaves
    the block; the walk from the first event over blocks doubles these pointers, so its number of joins is the logarithm of
    the number of blocks; then each block that is entered is walked once. start and end are numbers or times that aren't null; starts
    are unique for each key.
    """
    ks = list(keys)
    e = events.withColumn("_s", F.col(start)).withColumn("_e", F.col(end))
    # next: the first start at or after the end, by a sorted union, in one shuffle.
    last = Window.partitionBy(*ks).orderBy("_at", "_tag").rowsBetween(0, Window.unboundedFollowing)
    none = F.lit(None).cast(e.schema["_s"].dataType)
    ends = e.select(*ks, F.col("_s").alias("_from"), F.col("_e").alias("_at"), F.lit(0).alias("_tag"), none.alias("_start"))
    starts = e.select(*ks, none.alias("_from"), F.col("_s").alias("_at"), F.lit(1).alias("_tag"), F.col("_s").alias("_start"))
    nxt = ends.unionByName(starts).withColumn("_next", F.first("_start", ignorenulls=True).over(last)).where("_tag = 0")
    by_start = Window.partitionBy(*ks).orderBy("_from")
    nxt = nxt.withColumn("_next", F.when(F.col("_next") <= F.col("_from"), F.lead("_from").over(by_start)).otherwise(F.col("_next")))
    rank = F.row_number().over(by_start) - 1
    nxt = cut(nxt.select(*ks, "_from", F.coalesce("_next", "_from").alias("_to"), F.col("_next").isNotNull().alias("_more"), F.floor(rank / block).alias("_block"), (rank == 0).alias("_in")))
    types = {f.name: f.dataType.simpleString() for f in nxt.schema}
    by = ", ".join(f"{k} {types[k]}" for k in ks)

    def steps(pdf: pd.DataFrame):
        pdf = pdf.sort_values("_from", ignore_index=True)
        at = pdf["_from"].searchsorted(pdf["_to"])
        inside = pdf["_more"] & (pdf["_to"] <= pdf["_from"].iloc[-1])
        return pdf, at.tolist(), inside.tolist()

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, inside = steps(pdf)
        out = list(range(len(at)))
        for i in range(len(at) - 1, -1, -1):
            if inside[i]:
                out[i] = out[at[i]]
        final = pdf.iloc[out].reset_index(drop=True)
        return pdf[[*ks, "_from"]].assign(_to=final["_to"], _more=final["_more"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, inside = steps(pdf)
        kept, i = [], int(pdf["_in"].to_numpy().argmax())
        while pdf["_in"].any():
            kept.append(i)
            if not inside[i]:
                break
            i = at[i]
        return pdf.iloc[kept][[*ks, "_from"]].rename(columns={"_from": "_s"})

    if nxt.where("_block > 0").take(1):
        jump = cut(nxt.groupBy(*ks, "_block").applyInPandas(leave, f"{by}, _from {types['_from']}, _to {types['_from']}, _more boolean").where("_more"))
        entered = cut(nxt.where("_in").select(*ks, "_from"))
        while (more := cut(entered.join(jump, [*ks, "_from"]).select(*ks, F.col("_to").alias("_from")).join(entered, [*ks, "_from"], "left_anti"))).take(1):
            entered = cut(entered.unionByName(more).distinct())
            hop = jump.select(*ks, F.col("_from").alias("_to"), F.col("_to").alias("_far"))
            jump = cut(jump.join(hop, [*ks, "_to"]).select(*ks, "_from", F.col("_far").alias("_to")))
        nxt = nxt.drop("_in").join(entered.withColumn("_in", F.lit(True)), [*ks, "_from"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    kept = nxt.groupBy(*ks, "_block").applyInPandas(walk, f"{by}, _s {types['_from']}")
    return e.join(kept, [*ks, "_s"], "left_semi").drop("_s", "_e")
