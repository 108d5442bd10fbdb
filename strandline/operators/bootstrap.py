"""Block bootstrap as tables: weights of block starts, drawn starts by a seeded hash, and the index table that is joined to a series by place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recency_weights(series: DataFrame, block: int, ratio: float, key: str = "symbol", place: str = "k") -> DataFrame:
    """key, k, weight: geometric weights of the starts 0..n-block-1, `ratio` from one end to the other."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key)) - block
    return series.select(key, place, n.alias("m")).where(F.col(place) < F.col("m")).select(key, F.col(place).alias("k"), F.pow(F.lit(ratio), (F.col(place) + 1) / F.col("m")).alias("weight"))


def stair_weights(series: DataFrame, block: int, step: str, shares: Sequence[float] = (0.1, 0.3, 0.6), key: str = "symbol", place: str = "k", time: str = "time") -> DataFrame:
    """key, k, weight: starts of the last `step` share shares[2], those of the step before shares[1], all older ones shares[0]; weights sum to 1."""
    by = Window.partitionBy(key)
    s = series.select(key, F.col(place).alias("k"), time, F.max(time).over(by).alias("fin"), (F.count(F.lit(1)).over(by) - block + 1).alias("m")).where("k < m")
    part = F.when(F.col(time) >= F.col("fin") - F.expr(step), 2).when(F.col(time) >= F.col("fin") - F.expr(step) - F.expr(step), 1).otherwise(0)
    s = s.withColumn("part", part)
    raw = F.element_at(F.array(*map(F.lit, shares)), F.col("part") + 1) / F.count(F.lit(1)).over(Window.partitionBy(key, "part"))
    return s.withColumn("raw", raw).select(key, "k", (F.col("raw") / F.sum("raw").over(by)).alias("weight"))


def block_indices(weights: DataFrame, block: int, blocks: int, iterations: int, seed: str = "boot", key: str = "symbol") -> DataFrame:
    """key, it, blk, k: the places of every iteration, drawn with replacement by the weights. A draw is a hash of seed, key, iteration and
    block, so reruns agree; it meets the cumulative weights by a sorted union, not by pairs."""
    w = Window.partitionBy(key).orderBy("k")
    c = weights.select(key, "k", (F.sum("weight").over(w) / F.sum("weight").over(Window.partitionBy(key))).alias("hi"))
    d = weights.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("it")).select(key, "it", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key, "it", "blk")), 1, 12), 16, 10).cast("long")
    d = d.withColumn("u", (bits + 0.5) / float(2**48))
    u = c.select(key, F.col("hi").alias("at"), F.lit(1).alias("side"), "k", F.lit(None).cast("int").alias("it"), F.lit(None).cast("int").alias("blk")).unionByName(d.select(key, F.col("u").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("k"), "it", "blk"))
    # The first start whose cumulative weight is beyond the draw: of equal values the weight (side 1) would follow the draw, so it sorts before it.
    nxt = F.first("k", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", F.desc("side")).rowsBetween(0, Window.unboundedFollowing))
    drawn = u.withColumn("k", nxt).where("side = 0")
    return drawn.select(key, "it", "blk", F.explode(F.sequence(F.col("k"), F.col("k") + block - 1)).alias("k"))
