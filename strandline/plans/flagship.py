"""The flagship: hourly bars, Bollinger z-score, entries below -1, exits above 0, log returns after commission, by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.windows import bollinger, zscore
from strandline.operators.events import crossed, crossings, non_overlapping, paired_trades, refractory
from strandline.sources.tables import BARS

from . import sqltext as S
from .registry import query


def reversion_trades(bars: DataFrame, n: int = 20) -> DataFrame:
    """Trades of the rule: symbol, t0, i0, t1, i1."""
    z = bars.withColumn("z", bollinger("close", n))
    return paired_trades(z, crossed("z", -1.0, False), crossed("z", 0.0, True))


def with_prices(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds p0 and p1, the closes at bars i0 and i1."""
    p = bars.select("symbol", "bar_id", "close")
    out = events.join(p.select("symbol", F.col("bar_id").alias("i0"), F.col("close").alias("p0")), ["symbol", "i0"])
    return out.join(p.select("symbol", F.col("bar_id").alias("i1"), F.col("close").alias("p1")), ["symbol", "i1"])


def trade_returns(events: DataFrame, commission: float = 0.001) -> DataFrame:
    return events.withColumn("lret", F.log1p(F.col("p1") / F.col("p0") - commission - 1))


TRADES_SQL = BARS + f""", z0 as (select *, ln(close) as lc from bars), z1 as (select *, {S.z('lc', 20)} as z from z0{S.windows(S.z('lc', 20))}),
z2 as (select *, lag(z) over (partition by symbol order by bar_id) as zp from z1),
sig as (select symbol, time, bar_id, 0 as kind from z2 where z <= -1 and zp > -1 union all select symbol, time, bar_id, 1 from z2 where z >= 0 and zp < 0),
sig1 as (select *, lag(kind) over (partition by symbol order by bar_id, kind) as before from sig),
sig2 as (select *, lead(time) over (partition by symbol order by bar_id, kind) as t1, lead(bar_id) over (partition by symbol order by bar_id, kind) as i1 from sig1 where before is null or before <> kind),
trades as (
  select s.symbol, s.time as t0, s.bar_id as i0, s.t1, s.i1, a.close as p0, b.close as p1, ln(b.close / a.close - 0.001) as lret
  from sig2 s join bars a on a.symbol = s.symbol and a.bar_id = s.bar_id join bars b on b.symbol = s.symbol and b.bar_id = s.i1 where s.kind = 0 and s.t1 is not null)"""


def trades_of(t) -> DataFrame:
    return trade_returns(with_prices(reversion_trades(t.bars), t.bars))


@query("flagship_reversion", f"with {TRADES_SQL} select symbol, count(*) as n, round(sum(lret), 6) as total, round(avg(lret) / nullif(stddev_samp(lret), 0) * sqrt(count(*)), 6) as z from trades group by symbol")
def flagship(t):
    z = F.try_divide(F.avg("lret"), F.stddev_samp("lret")) * F.sqrt(F.count(F.lit(1)).cast("double"))
    return trades_of(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lret"), 6).alias("total"), F.round(z, 6).alias("z"))


@query("e2_pair_entries", f"with {TRADES_SQL} select symbol, t0, i0, t1, i1 from trades")
def e2(t):
    return reversion_trades(t.bars)


@query("l11_trade_returns", f"with {TRADES_SQL} select symbol, i0, i1, round(lret, 6) as lret from trades")
def l11(t):
    return trades_of(t).select("symbol", "i0", "i1", F.round("lret", 6).alias("lret"))


@query("e1_crossings", S.steps(BARS, "bars", [{"lc": "ln(close)"}, {"z": S.z("lc", 20)}, {"zp": "lag(z) over o"}], "symbol, time, bar_id, round(z, 6) as z", "where z <= -1 and zp > -1"))
def e1(t):
    z = t.bars.withColumn("z", bollinger("close", 20))
    return crossings(z, "z", -1.0, up=False).select("symbol", "time", "bar_id", F.round("z", 6).alias("z"))


@query("e5_refractory", S.steps(BARS, "bars", [{"lc": "ln(close)"}, {"z": S.z("lc", 10)}, {"sg": "coalesce(z > 1, false)::int"}, {"q": "sum(sg) over r_5p_1p", "c": "count(sg) over r_5p_1p"}], "symbol, bar_id", "where sg = 1 and q = 0 and c = 5"))
def e5(t):
    z = t.bars.withColumn("z", zscore(F.ln("close"), 10))
    return refractory(z, F.col("z") > 1, 5).select("symbol", "bar_id")


_OPEN = "with recursive " + BARS + ", ev as (select symbol, bar_id as i0, bar_id + 1 + bar_id % 7 as i1 from bars where close < open)"


def sample_events(t) -> DataFrame:
    """Falling bars held for one to seven bars: overlapping events with ends that are not in order."""
    return t.bars.where("close < open").select("symbol", F.col("bar_id").alias("i0"), (F.col("bar_id") + 1 + F.col("bar_id") % 7).alias("i1"))


@query("e7_non_overlapping", _OPEN + """,
kept as (
  select symbol, min(i0) as i0 from ev group by symbol
  union all
  select k.symbol, (select min(n.i0) from ev n where n.symbol = k.symbol and n.i0 >= e.i1) from kept k join ev e on e.symbol = k.symbol and e.i0 = k.i0
  where exists (select 1 from ev n where n.symbol = k.symbol and n.i0 >= e.i1))
select ev.symbol, ev.i0, ev.i1 from ev join kept using (symbol, i0)""")  # fmt: skip
def e7(t):
    return non_overlapping(sample_events(t), "i0", "i1")


@query("e8_non_overlapping_bars", _OPEN.replace("bar_id + 1 + bar_id % 7", "bar_id + 5") + """,
kept as (
  select symbol, min(i0) as i0 from ev group by symbol
  union all
  select k.symbol, (select min(n.i0) from ev n where n.symbol = k.symbol and n.i0 >= k.i0 + 5) from kept k where exists (select 1 from ev n where n.symbol = k.symbol and n.i0 >= k.i0 + 5))
select symbol, i0 from kept""")  # fmt: skip
def e8(t):
    return non_overlapping(sample_events(t).withColumn("i1", F.col("i0") + 5), "i0", "i1").select("symbol", "i0")
