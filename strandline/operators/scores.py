"""Scores of predicted probabilities p against labels y (0 or 1), as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_loss(y: str, p: str, weight: str) -> Column:
    hit = F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))
    return F.try_divide(-F.sum(F.col(weight) * F.ln(hit)), F.sum(weight))


def accuracy(y: str, p: str, weight: str, level: float = 0.5) -> Column:
    return F.try_divide(F.sum(F.when((F.col(p) >= level).cast("int") == F.col(y), F.col(weight)).otherwise(0.0)), F.sum(weight))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def by_threshold(scored: DataFrame, levels: Sequence[float], key: str = "symbol") -> DataFrame:
    """key, thr, precision, recall, f1, f2 (ten parts precision, one part recall); 0 where undefined."""
    s = scored.withColumn("thr", F.explode(F.array(*map(F.lit, levels)))).withColumn("hit", (F.col("p") >= F.col("thr")).cast("int"))
    g = s.groupBy(key, "thr").agg(F.sum(F.col("y") * F.col("hit")).cast("double").alias("tp"), F.sum("hit").alias("pp"), F.sum("y").alias("ap"))
    g = g.select(key, "thr", _share(F.col("tp"), F.col("pp")).alias("a"), _share(F.col("tp"), F.col("ap")).alias("b"))
    f1 = _share(2 * F.col("a") * F.col("b"), F.col("a") + F.col("b"))
    return g.select(key, "thr", F.round("a", 6).alias("precision"), F.round("b", 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round((F.col("a") * 10 + F.col("b")) / 11, 6).alias("f2"))


def report(scored: DataFrame, key: str = "symbol", level: float = 0.5) -> DataFrame:
    """key, label, precision, recall, f1, support."""
    s = scored.withColumn("label", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("hit", (F.col("p") >= level).cast("int") == F.col("label")).withColumn("own", F.col("y") == F.col("label"))
    n = lambda c: F.count(F.when(c, 1))
    g = s.groupBy(key, "label").agg(n(F.col("own") & F.col("hit")).alias("tp"), n(F.col("hit")).alias("pp"), n(F.col("own")).alias("support"))
    return g.select(key, "label", F.round(_share(F.col("tp"), F.col("pp")), 6).alias("precision"), F.round(_share(F.col("tp"), F.col("support")), 6).alias("recall"), F.round(_share(2 * F.col("tp"), F.col("pp") + F.col("support")), 6).alias("f1"), "support")
