"""Cleaning and alignment of series: spans, duplicates, samples, sessions, digits, tickers in titles, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.windows import col


def common_span(df: DataFrame, key: str = "symbol", time: str = "time") -> DataFrame:
    """Rows between the latest first time and the earliest last time of the keys."""
    each = df.groupBy(key).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    span = each.agg(F.max("a").alias("_a"), F.min("b").alias("_b"))  # one row
    return df.join(F.broadcast(span), F.col(time).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def first_of_day(df: DataFrame, key: str = "symbol", time: str = "time") -> DataFrame:
    w = Window.partitionBy(key, F.to_date(time)).orderBy(time)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def separate_times(df: DataFrame, order: str, key: str = "symbol", time: str = "time") -> DataFrame:
    """Times that repeat get i microseconds more for the i-th repetition."""
    nth = F.row_number().over(Window.partitionBy(key, time).orderBy(order)) - 1
    return df.withColumn(time, F.col(time) + F.make_dt_interval(secs=nth / 1e6))


def finite(x: str | Column) -> Column:
    """x, null where it is not a number or not finite."""
    return F.when(~F.isnan(col(x)) & (F.abs(col(x)) != float("inf")), col(x))


def evenly_spaced(df: DataFrame, k: int, key: str = "symbol", place: str = "bar_id") -> DataFrame:
    """k rows of each key at floor(i (n - 1) / (k - 1)); place is dense from 0. Rows that are chosen twice are listed once."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    at = sizes.select(key, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i"), "_n").select(key, F.floor(F.col("_i") * (F.col("_n") - 1) / max(1, k - 1)).alias(place)).distinct()
    return df.join(at, [key, place], "left_semi")


def in_session(time: str | Column, zone: str = "America/New_York", source: str = "UTC") -> Column:
    """Monday to Friday from 09:30 to 16:00, both included, in zone; time is without zone and is that of source."""
    t = F.convert_timezone(F.lit(source), F.lit(zone), col(time).cast("timestamp_ntz"))
    return (F.weekday(t) < 5) & F.date_format(t, "HH:mm:ss").between("09:30:00", "16:00:00")


def round_down(x: str | Column, mod: float, room: float = 0.005) -> Column:
    y = col(x) * (1 + room)
    return y - F.pmod(y, F.lit(mod))


def significant(x: str | Column, n: int, how: str = "round") -> Column:
    """x to n significant digits by round (half to even), ceil or floor; 0 stays."""
    scale = F.pow(F.lit(10.0), n - 1 - F.floor(F.log10(F.abs(col(x)))))
    f = {"round": F.rint, "ceil": F.ceil, "floor": F.floor}[how]
    return F.when(col(x) == 0, F.lit(0.0)).otherwise(f(col(x) * scale).cast("double") / scale)


#: Quote currencies that are not tickers of a listing.
NOT_TICKERS = ("USDT", "KRW", "BTC")


def title_tickers(title: str | Column, marker: str) -> Column:
    """Distinct words in brackets before `marker`; where there are none, the words of capitals alone that are no quote currency."""
    before = F.regexp_extract(col(title), rf"(?s)^(.*?){marker}", 1)
    bracketed = F.array_distinct(F.regexp_extract_all(before, F.lit(r"(?U)\((\w+)\)"), 1))
    capitals = F.filter(F.split(col(title), r"[^\w]+"), lambda s: s.rlike("^[A-Z]{2,}$"))
    return F.when(F.size(bracketed) > 0, bracketed).otherwise(F.array_except(F.array_distinct(capitals), F.array(*map(F.lit, NOT_TICKERS))))


def liquidation_price(entry: str | Column, leverage: float, long: bool = True, added: float | Column = 0.0) -> Column:
    """Of an isolated position: long (E (1 - 1/L) - added) 1.005, short (E (1 + 1/L) + added) 0.995; added is margin put in later, for each unit."""
    if long:
        return (col(entry) * (1 - 1 / leverage) - added) * 1.005
    return (col(entry) * (1 + 1 / leverage) + added) * 0.995
