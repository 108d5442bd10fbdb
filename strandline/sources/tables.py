"""The market views that the queries run on, derived from the driver's tables, and the same views as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.bars import hourly_bars, number_bars


class Tables:
    """The tables of one folder. Views are lazy; columns that a query doesn't use are pruned from the scan."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        """Events of positive value as trades: symbol, time, id, price, qty."""
        qty = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long") + 1
        return self.read("events").where("value > 0").select(F.col("event_type").alias("symbol"), F.col("ts").alias("time"), F.col("event_id").alias("id"), F.col("value").alias("price"), qty.alias("qty"))

    @cached_property
    def bars(self) -> DataFrame:
        """Hourly bars of ticks with a dense bar_id for each symbol."""
        return number_bars(hourly_bars(self.ticks))

    @cached_property
    def days(self) -> DataFrame:
        """Daily price of lineitem by return flag: symbol, time, high, low, close (mean), volume, bar_id."""
        price = F.col("l_extendedprice") / F.col("l_quantity")
        d = self.read("lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("time"))
        d = d.agg(F.max(price).alias("high"), F.min(price).alias("low"), F.round(F.avg(price), 6).alias("close"), F.sum("l_quantity").alias("volume"))
        return number_bars(d)

    @cached_property
    def pair(self) -> DataFrame:
        """Two symbols' bars at the hours that both have: symbol (of the pair), time, y, x, bar_id."""
        a, b = (self.bars.where(F.col("symbol") == s).select("time", F.col("close").alias(c)) for s, c in (("click", "y"), ("view", "x")))
        return number_bars(a.join(b, "time").withColumn("symbol", F.lit("click/view")))

    @cached_property
    def pairs(self) -> DataFrame:
        """Every two symbols' bars at the hours that both have, as in pair: a join by the hour, with as many rows an hour as there are pairs of symbols."""
        a, b = (self.bars.select(F.col("symbol").alias(s), "time", F.col("close").alias(c)) for s, c in (("_a", "y"), ("_b", "x")))
        both = a.join(b, "time").where("_a < _b").select(F.concat_ws("/", "_a", "_b").alias("symbol"), "time", "y", "x")
        return number_bars(both)


#: The same views for SQL, to go after `with`.
TICKS = """ticks as (
  select event_type as symbol, ts as time, event_id as id, value as price, regexp_extract(props, '"k": *([0-9]+)', 1)::bigint + 1 as qty
  from events where value > 0)"""
BARS = TICKS + """, bars0 as (
  select symbol, date_trunc('hour', time) as time, first(price order by time, id) as open, max(price) as high, min(price) as low,
    last(price order by time, id) as close, sum(qty)::bigint as volume, sum(price * qty) as dollar, count(*) as n from ticks group by all),
bars as (select *, row_number() over (partition by symbol order by time) - 1 as bar_id from bars0)"""
DAYS = """days0 as (
  select l_returnflag as symbol, l_shipdate as time, max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
    round(avg(l_extendedprice / l_quantity), 6) as close, sum(l_quantity) as volume from lineitem group by all),
days as (select *, row_number() over (partition by symbol order by time) - 1 as bar_id from days0)"""
PAIR = BARS + """, pair0 as (
  select 'click/view' as symbol, time, a.close as y, b.close as x from bars a join bars b using (time) where a.symbol = 'click' and b.symbol = 'view'),
pair as (select *, row_number() over (partition by symbol order by time) - 1 as bar_id from pair0)"""
PAIRS = BARS + """, pairs0 as (
  select a.symbol || '/' || b.symbol as symbol, a.time, a.close as y, b.close as x from bars a join bars b on a.time = b.time and a.symbol < b.symbol),
pairs as (select *, row_number() over (partition by symbol order by time) - 1 as bar_id from pairs0)"""
