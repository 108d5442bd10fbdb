"""Statistics of paths and of coded strings. Paths are rows (keys, step, value), so each is an aggregate over a group of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import ols

KEYS = ("symbol", "i0")


def _steps(keys: tuple[str, ...] = KEYS):
    return Window.partitionBy(*keys).orderBy("step")


def last_residual(p: DataFrame, least: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, value: the last residual of the trend line over the population deviation of all residuals; null under `least` points."""
    f = ols("value", "step")
    g = p.groupBy(*keys).agg(F.count("value").alias("n"), f["slope"].alias("b"), f["intercept"].alias("a"), f["rss"].alias("rss"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("step"))).alias("y"), F.max(F.when(F.col("value").isNotNull(), F.col("step"))).alias("x"))
    return g.select(*keys, F.when(F.col("n") >= least, F.try_divide(F.col("y") - F.col("a") - F.col("b") * F.col("x"), F.sqrt(F.col("rss") / F.col("n")))).alias("value"))


def ar1(p: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, value: the t value, with the slope's sign, of the value on the one before it. The first pair is left out."""
    q = p.withColumn("x", F.lag("value").over(_steps(keys))).withColumn("x", F.when(F.row_number().over(_steps(keys)) > 2, F.col("x")))
    f = ols("value", "x")
    return q.groupBy(*keys).agg((F.signum(f["slope"]) * f["t"]).alias("value"))


def hurst(p: DataFrame, lags: range, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, value: half the slope of the logarithm of the variance of lagged differences of log returns on that of the lag."""
    r = p.withColumn("r", F.ln(F.col("value") / F.lag("value").over(_steps(keys))))
    d = r.select(*keys, *[(F.col("r") - F.lag("r", k).over(_steps(keys))).alias(f"d{k}") for k in lags])
    g = d.groupBy(*keys).agg(*[F.var_pop(f"d{k}").alias(f"v{k}") for k in lags])
    long = g.select(*keys, F.explode(F.array(*[F.struct(F.ln(F.lit(float(k))).alias("x"), F.ln(f"v{k}").alias("y")) for k in lags])).alias("o")).select(*keys, "o.*")
    return long.groupBy(*keys).agg((F.try_divide(F.regr_sxy("y", "x"), F.regr_sxx("y", "x")) / 2).alias("value"))


def through_origin(p: DataFrame, y: str, x: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, value: the t value of a regression without intercept; its variance is of n - 1 degrees."""
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    on = lambda e: F.sum(F.when(ok, e))
    g = p.groupBy(*keys).agg(on(F.col(x) * F.col(y)).alias("xy"), on(F.col(x) * F.col(x)).alias("xx"), on(F.col(y) * F.col(y)).alias("yy"), F.count(F.when(ok, 1)).alias("n"))
    b = F.try_divide("xy", "xx")
    var = F.try_divide(F.greatest(F.col("yy") - b * F.col("xy"), F.lit(0.0)), (F.col("n") - 1) * F.col("xx"))
    return g.select(*keys, F.try_divide(b, F.sqrt(var)).alias("value"))


def roll_variance(p: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, value: the variance of changes less twice their covariance with the change after."""
    q = p.withColumn("nxt", F.lead("value").over(_steps(keys)))
    return q.groupBy(*keys).agg((F.var_samp("value") - 2 * F.covar_samp("value", "nxt")).alias("value"))


def signs(p: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, msg: a 1 for each value above 0 and a 0 for each other, in order."""
    at = F.array_sort(F.collect_list(F.struct("step", F.when(F.col("value") > 0, "1").otherwise("0").alias("c"))))
    return p.where("value is not null").groupBy(*keys).agg(F.array_join(F.transform(at, lambda s: s["c"]), "").alias("msg"))


def plug_in_entropy(df: DataFrame, msg: str, w: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, value: the entropy rate in bits of the words of w letters of the reversed message; the last word is not counted."""
    words = df.where(F.length(msg) > w).select(*keys, F.reverse(msg).alias("m")).select(*keys, F.expr(f"explode(transform(sequence(1, length(m) - {w}), k -> substring(m, k, {w})))").alias("g"))
    n = words.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return n.withColumn("p", share).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p")) / w).alias("value"))


def runs_test(msg: Column) -> Column:
    """The runs test's z score of a string of 0 and 1; null where all are the same."""
    n0, n1 = F.length(F.regexp_replace(msg, "1", "")).cast("double"), F.length(F.regexp_replace(msg, "0", "")).cast("double")
    # A run begins at the start and at each change.
    runs = F.length(F.regexp_replace(F.regexp_replace(msg, "0+", "0"), "1+", "1"))
    mean = F.try_divide(2 * n0 * n1, n0 + n1) + 1
    var = F.try_divide(2 * n0 * n1 * (2 * n0 * n1 - n0 - n1), (n0 + n1) * (n0 + n1) * (n0 + n1 - 1))
    return F.try_divide(runs - mean, F.sqrt(var))
