"""Messages out of series by quantiles or deviations of all history, and the match-length entropy of messages."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import prefix
from strandline.sources.scratch import cut

from .blocks import before_blocks, sized
from .paths import in_reach

KEYS = ("symbol", "i0")


def prefix_ranks(rows: DataFrame, x: str, key: str = "symbol", at: str = "bar_id", block: int = 4096, splits: int = 256) -> DataFrame:
    """rows, whose x isn't null, with `rank`: how many rows of the key up to each have an x that is not greater, and `n`: how many rows there are up to it.

    Counts in two levels: rows are in blocks by place and in `splits` blocks by value (approximate quantiles, which only deal them). A row counts the
    cells of earlier blocks and smaller value blocks from a table, the rows of earlier blocks in its own value block, and the rows before it
    in its own block; so no key is one task and nothing is counted pair by pair beyond a block.
    """
    cuts = rows.groupBy(key).agg(F.percentile_approx(x, [k / splits for k in range(1, splits)], 10_000).alias("_cuts"))
    t = rows.join(sized(cuts), key).withColumn("_b", F.floor(F.col(at) / block)).withColumn("_v", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")
    t = cut(t)
    cells = t.groupBy(key, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    # Cells of earlier blocks, then of smaller values: a row for each block and value block.
    grid = t.select(key, "_b").distinct().join(t.select(key, "_v").distinct(), key).join(cells, [key, "_b", "_v"], "left")
    past = F.coalesce(F.sum("_c").over(Window.partitionBy(key, "_v").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = Window.partitionBy(key, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    table = grid.withColumn("_p", past).select(key, "_b", "_v", F.coalesce(F.sum("_p").over(below), F.lit(0)).alias("_less"))
    table = table.join(cells, [key, "_b", "_v"], "left_semi")

    def counted(group: list[str], name: str, earlier):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_at", ignore_index=True)
            x, p = pdf["_x"].to_numpy(float), earlier(pdf)
            out = np.zeros(len(pdf), np.int64)
            for k in range(0, len(pdf), 512):
                s = slice(k, k + 512)
                out[s] = ((x[None, : k + 512] <= x[s, None]) & p(s, slice(0, k + 512))).sum(axis=1)
            return pdf[[key, "_at"]].assign(**{name: out})

        cols = t.select(key, F.col(at).alias("_at"), F.col(x).cast("double").alias("_x"), "_b", "_v")
        kinds = {f.name: f.dataType.simpleString() for f in t.schema}
        return cols.groupBy(*group).applyInPandas(run, f"{key} {kinds[key]}, _at {kinds[at]}, {name} long")

    def by_block(pdf: pd.DataFrame):
        b = pdf["_b"].to_numpy()
        return lambda s, o: b[None, o] < b[s, None]

    def by_place(pdf: pd.DataFrame):
        n = np.arange(len(pdf))
        return lambda s, o: n[None, o] <= n[s, None]

    same = counted([key, "_v"], "_same", by_block).join(counted([key, "_b"], "_own", by_place), [key, "_at"])
    t = before_blocks(t, [key], "_b", sums={"_n": F.lit(1)})
    t = t.withColumn("n", F.col("_n") + F.row_number().over(Window.partitionBy(key, "_b").orderBy(at)))
    t = t.join(table, [key, "_b", "_v"]).join(same.withColumnRenamed("_at", at), [key, at])
    return t.withColumn("rank", F.col("_less") + F.col("_same") + F.col("_own")).drop("_b", "_v", "_n", "_less", "_same", "_own")


def quantile_messages(events: DataFrame, bars: DataFrame, x: str, window: int, bins: int, block: int = 4096) -> DataFrame:
    """symbol, i0, msg: the last `window` values before and at the event, each as its bin among the quantiles of all values up to the event.

    The quantiles themselves aren't needed: of n values, one that r of them don't exceed is at or above the k-th of `bins` interpolated
    quantiles if and only if (r - 1) * bins >= (n - 1) * k. Ranks are taken once, at each value's own bar; those up to the event
    differ by what is in the window.
    """
    ranked = prefix_ranks(bars.select("symbol", "bar_id", F.col(x).alias("x")).where("x is not null"), "x", block=block)
    p = in_reach(events.select("symbol", "i0"), ranked, window - 1, 0)
    got = p.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("bar_id", "x", "rank", "n"))).alias("w"))
    n = F.element_at("w", -1)["n"]
    rank = lambda e: e["rank"] + F.size(F.filter("w", lambda o: (o["bar_id"] > e["bar_id"]) & (o["x"] <= e["x"])))
    digit = lambda e: F.when(n == 1, F.lit(bins - 1)).otherwise(F.least(F.lit(bins - 1), F.floor((rank(e) - 1) * bins / (n - 1))))
    return got.select(*KEYS, F.array_join(F.transform("w", lambda e: digit(e).cast("string")), "").alias("msg"))


def deviation_messages(events: DataFrame, bars: DataFrame, x: str, window: int) -> DataFrame:
    """symbol, i0, msg: as by quantiles, in bins of equal width, as many as deviations of all values so far go into their range."""
    lo, hi, sd = F.min(x).over(prefix()), F.max(x).over(prefix()), F.stddev_samp(x).over(prefix())
    e = events.select("symbol", "i0").join(bars.select("symbol", F.col("bar_id").alias("i0"), lo.alias("lo"), hi.alias("hi"), F.floor(F.try_divide(hi - lo, sd)).alias("n")), list(KEYS)).where("n > 0")
    digit = F.least(F.col("n") - 1, F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("n")))
    return _joined(in_reach(e, bars.select("symbol", "bar_id", x).where(F.col(x).isNotNull()), window - 1, 0), digit)


def _joined(p: DataFrame, digit: Column) -> DataFrame:
    at = F.array_sort(F.collect_list(F.struct("bar_id", digit.cast("string").alias("d"))))
    return p.groupBy(*KEYS).agg(F.array_join(F.transform(at, lambda s: s["d"]), "").alias("msg"))


def match_entropy(msg: str, window: int | None = None) -> float | None:
    """Kontoyiannis' estimate on the reversed message: the mean of log2(i + 1) over the shortest length not seen before, in the i letters before (or in the last `window`)."""
    m, n = msg[::-1], len(msg)
    if window is not None:
        window = min(window, n // 2)
    points = range(1, n // 2 + 1) if window is None else range(window, n - window + 1)
    total = 0.0
    for i in points:
        w = i if window is None else window
        found = 0
        for k in range(1, w + 1):
            if m.find(m[i : i + k], i - w, i + k - 1) < 0:  # starts before i; may run over it
                break
            found = len(m[i : i + k])
        total += math.log2(w + 1) / (found + 1)
    return total / len(points) if len(points) and n > 1 else None


def match_entropy_of(window: int | None = None):
    """match_entropy as a column function, in Arrow batches."""

    @F.pandas_udf("double")
    def run(msg: pd.Series) -> pd.Series:
        return msg.map(lambda m: match_entropy(m, window), na_action="ignore").astype(float)

    return run


def redundancy(entropy: Column, msg: Column) -> Column:
    """1 - entropy / log2 of the message's length: what is left of the entropy that its length allows. Null for messages under two letters."""
    return F.when(F.char_length(msg) > 1, 1 - entropy / F.log2(F.char_length(msg)))


def two_factor(events: DataFrame, bars: int, price: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """events(keys, i0, p0, vol) without those that overlap a kept one: started less than `bars` bars after it while ln(p / p0) was
    above -price * vol of the kept one; the look ahead stops at the first that fell further. Sequential by key over events, which are few next to bars."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i0", ignore_index=True)
        i, p, v = (pdf[c].tolist() for c in ("i0", "p0", "vol"))
        gone = [False] * len(i)
        for j in range(len(i)):
            k = j + 1
            while not gone[j] and k < len(i) and i[k] - i[j] < bars and math.log(p[k] / p[j]) > -price * v[j]:
                gone[k] = True
                k += 1
        return pdf[[not g for g in gone]]

    return events.groupBy(*keys).applyInPandas(walk, events.schema)

