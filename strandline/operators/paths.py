"""Paths of events, as-of lookups and interval joins. The symbol is always an equi-key, so these are hash joins with a bounded residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK as BLOCK_TIME
from .blocks import before_blocks, block_of, sized

#: Bars in a block of the bucketed range join.
BLOCK = 64


def in_reach(events: DataFrame, bars: DataFrame, back: int, ahead: int, at: str = "i0") -> DataFrame:
    """events with the bars from `back` before to `ahead` after bar `at`: adds bar_id and bars' other columns.

    Bars are joined by (symbol, block of BLOCK bars), an event looking in each block its path touches, so the work of an
    event doesn't grow with the history of its symbol.
    """
    lo, hi = F.col(at) - back, F.col(at) + ahead
    e = events.withColumn("_block", F.explode(F.sequence(F.floor(lo / BLOCK), F.floor(hi / BLOCK))))
    b = bars.withColumn("_block", F.floor(F.col("bar_id") / BLOCK))
    return e.join(b, ["symbol", "_block"]).where(F.col("bar_id").between(lo, hi)).drop("_block")


def path(events: DataFrame, bars: DataFrame, x: str, nbars: int, scale: int = 1, how: str = "last", forward: bool = False, at: str = "i0") -> DataFrame:
    """symbol, i0, step (0..nbars-1), value: the path of an event in nbars groups of scale bars, reduced by last, sum, avg, max or min.

    The path ends at the event's bar, or starts at it. Groups with a bar or a value missing have a null value, but for `last`, which
    needs the last bar only; groups without any bar are not listed.
    """
    n = nbars * scale - 1
    p = in_reach(events.select("symbol", F.col(at).alias("i0")).distinct(), bars.select("symbol", "bar_id", F.col(x).alias("v")), 0 if forward else n, n if forward else 0)
    step = F.floor((F.col("bar_id") - F.col("i0") + (0 if forward else n)) / scale)
    f = {"last": F.max_by("v", "bar_id"), "sum": F.sum("v"), "avg": F.avg("v"), "max": F.max("v"), "min": F.min("v")}[how]
    g = p.groupBy("symbol", "i0", step.alias("step")).agg(f.alias("value"), F.count("v").alias("n"))
    return g.select("symbol", "i0", "step", F.when(F.col("n") == scale, F.col("value")).alias("value"))


def as_of(left: DataFrame, right: DataFrame, key: str = "symbol", time: str = "time", strict: bool = False, forward: bool = False, suffix: str = "_r", block: str | int = BLOCK_TIME) -> DataFrame:
    """left with the last row of right at or before its time (strict: before), or the first at or after it (forward). Unmatched: null. Columns of right get the suffix.

    A sorted union by (key, block of time), linear in both sides and with no task that holds a key's history: the last row
    of right in each block (first, if forward) is carried over the blocks to come by a window over a row for each block. Of rows of right
    at one time any may be taken; a null key or time meets nothing.
    """
    cols = [c for c in right.columns if c != key]
    width = block_of(left, time, block)
    r_first = 1 if strict ^ forward else 0
    own = F.struct(*[F.col(c) for c in cols])
    right = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    r = right.select(key, F.col(time).alias("_t"), width.alias("_b"), F.lit(r_first).alias("_side"), own.alias("_r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    lf = left.select(key, F.col(time).alias("_t"), width.alias("_b"), F.lit(1 - r_first).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))
    # Forward goes down in time: a frame from the start of its partition is carried on row by row, one to its end is gone through anew for each.
    down = F.desc if forward else F.asc
    w = Window.partitionBy(key, "_b").orderBy(down("_t"), down("_side")).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(key).orderBy(down("_b")).rowsBetween(Window.unboundedPreceding, -1)
    u = lf.unionByName(r)
    ends = r.groupBy(key, "_b").agg((F.min_by if forward else F.max_by)("_r", "_t").alias("_end"))
    blocks = lf.select(key, "_b").distinct().join(ends, [key, "_b"], "full")
    carried = blocks.select(key, "_b", F.last("_end", ignorenulls=True).over(over).alias("_end"))
    m = u.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    m = m.join(sized(carried), (F.col(f"_l.{key}") == carried[key]) & (m["_b"] == carried["_b"]), "left").withColumn("_m", F.coalesce("_m", "_end"))
    return m.select("_l.*", *[F.col(f"_m.{c}").alias(f"{c}{suffix}") for c in cols])


def last_rows(events: DataFrame, rows: DataFrame, n: int, order: tuple[str, ...] = ("time", "id"), block: str | int = BLOCK_TIME) -> DataFrame:
    """events(symbol, time, ...) with each of the last n rows of its symbol strictly before its time: adds place (1 is the nearest) and rows' columns, the time as row_time. Events with none go.

    Rows are numbered within blocks of time and by how many came before; the number of the last one is an as-of lookup, and the n rows up to
    it are a bucketed range join.
    """
    r = before_blocks(rows.withColumn("_b", block_of(rows, "time", block)), ["symbol"], "_b", sums={"_before": F.lit(1)})
    r = r.withColumn("bar_id", F.col("_before") + F.row_number().over(Window.partitionBy("symbol", "_b").orderBy(*order)) - 1).drop("_before", "_b")
    newest = r.groupBy("symbol", "time").agg(F.max("bar_id").alias("i0"))
    e = as_of(events, newest, strict=True, block=block).where("i0_r is not null").withColumnRenamed("i0_r", "i0").drop("time_r")
    out = in_reach(e, r.withColumnRenamed("time", "row_time"), n - 1, 0)
    return out.withColumn("place", (F.col("i0") - F.col("bar_id") + 1).cast("int")).drop("i0", "bar_id")


def ols(y: str, x: str) -> dict[str, Column]:
    """Aggregates of a regression of y on x with intercept: slope, intercept, t value of the slope, correlation, residual deviation."""
    yy = F.when(F.col(x).isNotNull(), F.col(y))
    n, sxx, syy, sxy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    slope = F.try_divide(sxy, sxx)
    rss = F.greatest(syy - slope * sxy, F.lit(0.0))
    return {"slope": slope, "intercept": F.avg(yy) - slope * F.regr_avgx(y, x), "t": F.when(n > 2, F.try_divide(slope, F.sqrt(F.try_divide(rss / (n - 2), sxx)))), "corr": F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy)), "resid": F.when(n > 1, F.sqrt(rss / (n - 1))), "rss": rss}
