"""Exponential smoothing by windows alone.

A decayed sum over all rows so far would over- or underflow if it were one sum of powers, so rows go in blocks over which the
decay is about SMALL. A sum within the block and what the two blocks before it hand on give it to double precision: what
is older weighs less than SMALL squared. bar_id is dense. Nulls add nothing but age what came before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import col, order

SMALL = 1e-8


def block_rows(decay: float) -> int:
    return max(1, math.ceil(math.log(SMALL) / math.log(decay)))


def alpha_of(span: float) -> float:
    return 2.0 / (span + 1.0)


def decayed_sum_steps(name: str, x: str | Column, decay: float) -> list[dict[str, Column]]:
    """Columns to add one dict after another; the last is `name`: the sum of decay**(age in rows) * x over the rows so far."""
    n = block_rows(decay)
    place, whole = F.col("bar_id") % n, decay**n
    inner = Window.partitionBy("symbol", F.floor(F.col("bar_id") / n)).orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = order().rowsBetween(Window.unboundedPreceding, -1)
    at_end = lambda value: F.last(F.when(place == n - 1, value), ignorenulls=True).over(earlier)
    own, handed = f"_{name}_own", f"_{name}_before"
    return [
        {own: F.pow(F.lit(decay), place) * F.sum(F.coalesce(col(x), F.lit(0.0)) * F.pow(F.lit(decay), -place)).over(inner)},
        {handed: F.coalesce(at_end(F.col(own)), F.lit(0.0))},
        {name: F.col(own) + F.pow(F.lit(decay), place + 1) * F.coalesce(at_end(F.col(own) + whole * F.col(handed)), F.lit(0.0))},
    ]


def decayed_sum(df: DataFrame, name: str, x: str | Column, decay: float) -> DataFrame:
    for cols in decayed_sum_steps(name, x, decay):
        df = df.withColumns(cols)
    return df.drop(f"_{name}_own", f"_{name}_before")


def ewm(df: DataFrame, x: str, span: float, mean: str | None = None, std: str | None = None, least: int = 0) -> DataFrame:
    """Adds the exponentially weighted mean and sample deviation of x, with weights that are divided by their sum; null before `least` values."""
    q = 1 - alpha_of(span)
    one = F.when(F.col(x).isNotNull(), 1.0)
    seen = F.count(x).over(order().rowsBetween(Window.unboundedPreceding, 0)) >= max(1, least)
    df = decayed_sum(decayed_sum(df, "_w", one, q), "_s", x, q)
    avg = F.try_divide("_s", "_w")
    if mean:
        df = df.withColumn(mean, F.when(seen, avg))
    if std:
        df = decayed_sum(decayed_sum(df, "_w2", one, q * q), "_ss", F.col(x) * F.col(x), q)
        spread = F.greatest(F.try_divide("_ss", "_w") - avg * avg, F.lit(0.0))
        df = df.withColumn(std, F.when(seen, F.sqrt(F.try_divide(spread * F.col("_w") * F.col("_w"), F.col("_w") * F.col("_w") - F.col("_w2")))))
    return df.drop("_w", "_s", "_w2", "_ss")


def ema(df: DataFrame, name: str, x: str, alpha: float, least: int = 0) -> DataFrame:
    """Adds the recursive mean: the first value, then alpha of each value and the rest of the mean before; null before `least` values."""
    seen = F.count(x).over(order().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_seen", seen).withColumn("_x", F.when(F.col("_seen") == 1, F.col(x) / alpha).otherwise(F.col(x)))
    return decayed_sum(df, "_e", "_x", 1 - alpha).withColumn(name, F.when(F.col("_seen") >= max(1, least), alpha * F.col("_e"))).drop("_seen", "_x", "_e")


def wilder(df: DataFrame, name: str, x: str, n: int, mean: bool = False) -> DataFrame:
    """Adds Wilder's running sum of x (or mean): that of the first n values, then x and 1 - 1/n of the sum before."""
    seen = F.count(x).over(order().rowsBetween(Window.unboundedPreceding, 0))
    start = F.sum(x).over(order().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_seen", seen).withColumn("_x", F.when(F.col("_seen") == n, start).when(F.col("_seen") > n, F.col(x)))
    return decayed_sum(df, "_e", "_x", 1 - 1 / n).withColumn(name, F.when(F.col("_seen") >= n, F.col("_e") / (n if mean else 1))).drop("_seen", "_x", "_e")
