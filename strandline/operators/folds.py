"""Folds of labelled events and what overlaps what."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def time_folds(spark: SparkSession, splits: int, start: dt.date, end: dt.date, warm_up: int = 0, gap_days: int = 0) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end. A test begins on the day the one before ended; the last ends at `end`."""
    if warm_up >= splits:
        raise ValueError("warm_up must be less than splits")
    days = ((end - start).days + 1) // splits
    begin = F.date_add(F.lit(start), (F.col("fold") * (days - 1)).cast("int"))
    rows = spark.range(splits).select(F.col("id").alias("fold")).select("fold", begin.alias("test_start")).where(F.col("fold") >= warm_up)
    stop = F.when(F.col("fold") == splits - 1, F.lit(end)).otherwise(F.date_add("test_start", days - 1))
    return rows.select("fold", F.lit(start).alias("train_start"), F.date_sub("test_start", gap_days + 1).alias("train_end"), "test_start", stop.alias("test_end"))


def purged_folds(events: DataFrame, splits: int, embargo: float = 0.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, fold, i0, role (train, test). Test sets are contiguous and of near equal size; an event trains a fold if it
    ends by the start of its test, or starts at or after the latest end in it and an embargo of that share of all events.

    Fold bounds are a row for each fold, so events meet splits rows each and nothing else is joined.
    """
    w = Window.partitionBy(*keys).orderBy("i0")
    e = events.select(*keys, "i0", "i1", F.ntile(splits).over(w).alias("own"), (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
    bounds = e.groupBy(*keys, F.col("own").alias("fold")).agg(F.min("i0").alias("t0"), F.max("i1").alias("t1"), F.first(F.floor(F.col("n") * embargo)).alias("gap"))
    # The rank of the first event at or after the latest end of each test.
    after = e.join(bounds, list(keys)).groupBy(*keys, "fold").agg(F.min(F.when(F.col("i0") >= F.col("t1"), F.col("k"))).alias("right"))
    j = e.join(bounds.join(after, [*keys, "fold"]), list(keys))
    role = F.when(F.col("own") == F.col("fold"), "test").when((F.col("i1") <= F.col("t0")) | (F.col("k") >= F.col("right") + F.col("gap")), "train")
    return j.select(*keys, "fold", "i0", role.alias("role")).where("role is not null")


def spanned_folds(rows: DataFrame, splits: int, time: str = "time", warm_up: int = 0, gap_days: int = 0) -> DataFrame:
    """time_folds over the days from the first to the last row of a table: one row comes to the driver. A table without times has no folds."""
    first, last = rows.agg(F.min(F.to_date(time)), F.max(F.to_date(time))).first()
    spark = rows.sparkSession
    none = time_folds(spark, splits, dt.date(1970, 1, 1), dt.date(1970, 1, 1), warm_up, gap_days).where("false")
    return none if first is None else time_folds(spark, splits, first, last, warm_up, gap_days)


def fold_columns(events: DataFrame, splits: int, embargo: float = 0.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, i0, fold (0.., the one whose test it is in) and trains (the folds it trains): purged_folds in one row for each event, for PurgedCrossValidator."""
    f = purged_folds(events, splits, embargo, keys)
    own, of = F.max(F.when(F.col("role") == "test", F.col("fold"))) - 1, F.collect_set(F.when(F.col("role") == "train", F.col("fold") - 1))
    return f.groupBy(*keys, "i0").agg(own.cast("int").alias("fold"), F.sort_array(of).alias("trains"))


def overlaps(events: DataFrame, longest: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Pairs (a, b), a < b, of events i0..i1 that share a bar. Events are at most `longest` bars, so each looks in two blocks of so many."""
    e = events.select(*keys, "i0", "i1").withColumn("block", F.explode(F.sequence(F.floor(F.col("i0") / longest), F.floor(F.col("i1") / longest))))
    a = e.select(*keys, "block", F.col("i0").alias("a"), F.col("i1").alias("a1"))
    b = e.select(*keys, "block", F.col("i0").alias("b"), F.col("i1").alias("b1"))
    return a.join(b, [*keys, "block"]).where("a < b and b <= a1 and block = b div " + str(longest)).select(*keys, "a", "b")
