"""Queries of bars, paths, exits, labels, weights and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import metrics as M
from strandline.functions.windows import order
from strandline.operators import bars as B
from strandline.operators import labels as L
from strandline.operators.events import cusum_events
from strandline.operators.paths import as_of, ols, path
from strandline.operators.weights import time_decay, uniqueness
from strandline.sources.tables import BARS, TICKS

from .flagship import TRADES_SQL, trades_of
from .registry import query

EV = "with " + BARS + ", ev as (select symbol, bar_id as i0, close as p0, 0.2::double + (bar_id % 5) * 0.1::double as vol, bar_id + 10 as i1 from bars where close < open)"
_PATH = ", p as (select e.*, b.bar_id, b.close, b.high, b.low, b.bar_id - e.i0 as step from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 {a} and e.i0 {b})"


def falling(t) -> DataFrame:
    """Falling bars as events: symbol, i0, p0, vol, i1."""
    vol = F.lit(0.2) + (F.col("bar_id") % 5) * F.lit(0.1)
    return t.bars.where("close < open").select("symbol", F.col("bar_id").alias("i0"), F.col("close").alias("p0"), vol.alias("vol"), (F.col("bar_id") + 10).alias("i1"))


def _tick_bars_sql(size: int, target: str) -> str:
    o = "(partition by symbol order by time, id rows between unbounded preceding and current row)"
    return f"""with {TICKS}, c as (select *, {target} as target, sign(price - lag(price) over (partition by symbol order by time, id)) as s from ticks),
u as (select *, last_value(case when s <> 0 then s end ignore nulls) over {o} as up, sum(target) over {o} as cum from c),
x as (select *, coalesce(cum // {size} > (lag(cum) over (partition by symbol order by time, id)) // {size}, false) as crossed, (cum % {size})::bigint as rest from u),
pp as (select *, unnest(case when crossed and rest > 0 then [target - rest, rest] else [target] end) as part, unnest(case when crossed and rest > 0 then [0, 1] else [0] end) as piece from x),
op as (select *, case when piece = 1 then 1 when lag(crossed and rest = 0) over (partition by symbol order by time, id, piece) then 1 else 0 end as opens from pp),
bb as (select *, sum(opens) over (partition by symbol order by time, id, piece rows between unbounded preceding and current row)::bigint as bar, part / target::double as share, coalesce(up < 0, false) as buy from op)
select symbol, bar, min(time) as time0, max(time) as time1, first(price order by time, id, piece) as open, max(price) as high, min(price) as low, last(price order by time, id, piece) as close,
  sum(qty * share) as volume, sum(case when buy then qty * share else 0 end) as volume_buy, sum(price * qty * share) as dollar, sum(case when buy then price * qty * share else 0 end) as dollar_buy,
  count(up) as tick, sum(up)::bigint as net_tick, sum(price * qty * share) / sum(qty * share) as vwap from bb group by symbol, bar having sum(part) >= 0.999::double * {size}"""


@query("a1_volume_bars", _tick_bars_sql(5000, "qty"))
def a1(t):
    return B.tick_bars(t.ticks, 5000)


@query("a1_dollar_bars", _tick_bars_sql(50_000_000, "round(price * qty * 100)::bigint"))
def a1_dollar(t):
    return B.tick_bars(t.ticks, 50_000_000, "dollar")


@query("a2_tick_rule", f"""with {TICKS}, c as (select *, sign(price - lag(price) over (partition by symbol order by time, id)) as s from ticks)
select symbol, id, last_value(case when s <> 0 then s end ignore nulls) over (partition by symbol order by time, id rows unbounded preceding)::double as up from c""")  # fmt: skip
def a2(t):
    return B.tick_rule(t.ticks).select("symbol", "id", "up")


@query("a5_auto_size", f"""with {TICKS}, s as (select symbol, sum(qty) / ((epoch_us(max(time)) - epoch_us(min(time))) / 60e6 / 600) as raw from ticks group by symbol)
select symbol, round_even(raw * power(10.0::double, 3 - floor(log10(raw))), 0) / power(10.0::double, 3 - floor(log10(raw))) as size from s""")  # fmt: skip
def a5(t):
    return B.auto_size(t.ticks, 600)


@query("a6_coarsen", f"with {BARS} select symbol, bar_id // 5 as bar_id, min(time) as time, first(open order by bar_id) as open, max(high) as high, min(low) as low, last(close order by bar_id) as close, sum(volume)::bigint as volume from bars group by symbol, bar_id // 5")
def a6(t):
    return B.coarsen(t.bars, 5)


def _path_sql(f: str, ok: str = "count(v) = 2") -> str:
    return EV + f""", g as (select e.symbol, e.i0, (b.bar_id - e.i0 + 9) // 2 as step, b.bar_id, b.close as v from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 - 9 and e.i0)
select symbol, i0, step, round(case when {ok} then {f} end, 6) as value from g group by symbol, i0, step"""


for _how, _f in (("avg", "avg(v)"), ("sum", "sum(v)"), ("max", "max(v)"), ("min", "min(v)"), ("last", "arg_max(v, bar_id)")):

    @query(f"p1_path_{_how}", _path_sql(_f))
    def p1(t, how=_how):
        return path(falling(t), t.bars, "close", 5, 2, how).withColumn("value", F.round("value", 6))


@query("p8_as_of_entry", f"""with {BARS}, l as (select user_id, 'error' as symbol, min(ts) as time from events where event_type = 'error' group by user_id)
select l.user_id, l.time, b.bar_id, b.close from l asof left join bars b on b.symbol = l.symbol and l.time >= b.time""")  # fmt: skip
def p8(t):
    first = t.read("events").where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("time")).withColumn("symbol", F.lit("error"))
    return as_of(first, t.bars.select("symbol", "time", "bar_id", "close")).select("user_id", "time", F.col("bar_id_r").alias("bar_id"), F.col("close_r").alias("close"))


@query("r1_trend", EV + _PATH.format(a="- 9", b="") + """, g as (select symbol, i0, count(*) as n, regr_slope(close, step) as slope, regr_sxx(close, step) as sxx, regr_syy(close, step) as syy, regr_sxy(close, step) as sxy from p group by symbol, i0)
select symbol, i0, round(slope, 6) as slope, round(slope / nullif(sqrt(greatest(syy - slope * sxy, 0) / 8 / sxx), 0), 4) as t from g where n = 10""")  # fmt: skip
def r1(t):
    f = ols("value", "step")
    g = path(falling(t), t.bars, "close", 10).groupBy("symbol", "i0").agg(F.count("value").alias("n"), f["slope"].alias("slope"), f["t"].alias("t"))
    return g.where("n = 10").select("symbol", "i0", F.round("slope", 6).alias("slope"), F.round("t", 4).alias("t"))


@query("e3_cusum", "with recursive " + BARS + """, d as materialized (select symbol, bar_id, time, ln(close) - lag(ln(close)) over (partition by symbol order by bar_id) as dx from bars),
w as (
  select symbol, bar_id, time, 0.0::double as hi, 0.0::double as lo, false as up, false as down from d where bar_id = 0
  union all
  select d.symbol, d.bar_id, d.time, case when greatest(0, w.hi + dx) > 1 then 0 else greatest(0, w.hi + dx) end::double, case when least(0, w.lo + dx) < -1 then 0 else least(0, w.lo + dx) end::double, greatest(0, w.hi + dx) > 1, least(0, w.lo + dx) < -1
  from w join d on d.symbol = w.symbol and d.bar_id = w.bar_id + 1)
select symbol, time, bar_id, side::bigint as side from w, (values (-1), (1)) s(side) where (side = 1 and up) or (side = -1 and down)""")
def e3(t):
    return cusum_events(t.bars.withColumn("x", F.ln("close")).withColumn("h", F.lit(1.0)), "x", "h")


@query("l1_close_barriers", EV + _PATH.format(a="", b="+ 10") + """, g as (
  select symbol, i0, min(case when ln(close / p0) >= vol and step > 0 then step end) as tp, min(case when ln(close / p0) <= -vol and step > 0 then step end) as sl, max(bar_id) as fin from p group by symbol, i0)
select symbol, i0, least(i0 + coalesce(least(tp, sl), 10), fin) as i1, case when tp <= coalesce(sl, 11) then 'up' when sl is not null then 'down' else 'expiry' end as touch from g""")  # fmt: skip
def l1(t):
    return L.close_barriers(falling(t), t.bars, 10, 1.0, 1.0)


@query("l2_range_barriers", EV + _PATH.format(a="+ 1", b="+ 10") + """, g as (
  select symbol, i0, any_value(p0) as p0, any_value(vol) as vol, min(case when high > p0 + vol then bar_id end) as iu, min(case when low < p0 - vol then bar_id end) as il, max(case when step = 10 then close end) as pe from p group by symbol, i0),
h as (select *, case when iu is not null and (il is null or iu <= il) then 'up' when il is not null then 'down' when pe is not null then 'expiry' end as touch from g),
k as (select *, case touch when 'up' then p0 + vol when 'down' then p0 - vol when 'expiry' then pe end as p1 from h)
select symbol, i0, case touch when 'up' then iu when 'down' then il when 'expiry' then i0 + 10 end as i1, touch, round(p1, 6) as p1, round(p1 / p0 - 1 - 0.002, 12) as ret from k""")  # fmt: skip
def l2(t):
    out = L.range_barriers(falling(t), t.bars, 10, 1.0, 1.0, "vol", commission=0.001)
    return out.withColumn("p1", F.round("p1", 6)).withColumn("ret", F.round("ret", 12))


@query("l5_trailing_stop", EV + _PATH.format(a="", b="+ 9") + """, q as (select *, max(close) over (partition by symbol, i0 order by bar_id) as top, abs(exp(-vol) - 1) * p0 as d1, abs(exp(-vol * 0.5) - 1) * p0 as d2 from p),
g as (select symbol, i0, min(case when close <= p0 - d1 and step > 0 then step end) as sl, min(case when top >= p0 + d1 and close <= top - d2 and step > 0 then step end) as tr, max(bar_id) as fin from q group by symbol, i0)
select symbol, i0, least(i0 + coalesce(least(sl, tr), 9), fin) as i1, case when sl <= coalesce(tr, 10) then 'stop' when tr is not null then 'trail' else 'expiry' end as touch from g""")  # fmt: skip
def l5(t):
    return L.trailing_stop(falling(t), t.bars, 10, 1.0, 1.0, 0.5)


@query("l7_first_touch", EV + _PATH.format(a="", b="+ 10") + """, g as (select symbol, i0, any_value(i1) as i1, min(case when close / p0 - 1 > vol then bar_id end) as iu, min(case when close / p0 - 1 < -vol then bar_id end) as il from p group by symbol, i0)
select symbol, i0, iu, il, least(i1, iu, il) as i1 from g""")  # fmt: skip
def l7(t):
    return L.first_touch(falling(t), t.bars, 1.0, 1.0, longest=10)


@query("l8_bins", EV + """ select e.symbol, e.i0, round(b.close / e.p0 - 1 - 0.002, 12) as ret, sign(b.close / e.p0 - 1)::bigint as bin from ev e join bars b on b.symbol = e.symbol and b.bar_id = e.i1""")
def l8(t):
    ret, bin_ = L.bins(F.col("p0"), F.col("p1"), 0.001)
    p1 = t.bars.select("symbol", F.col("bar_id").alias("i1"), F.col("close").alias("p1"))
    return falling(t).join(p1, ["symbol", "i1"]).select("symbol", "i0", F.round(ret, 12).alias("ret"), bin_.alias("bin"))


_AHEAD = (1, 5, 20)


@query("l10_horizon_returns", f"with {BARS} select symbol, bar_id, " + ", ".join(f"round(lead(close, {h}) over (partition by symbol order by bar_id) / close - 1 - 0.002, 12) as ret_{h}" for h in _AHEAD) + " from bars")
def l10(t):
    return t.bars.select("symbol", "bar_id", *[F.round(F.lead("close", h).over(order()) / F.col("close") - 1 - 0.002, 12).alias(f"ret_{h}") for h in _AHEAD])


_WEIGHT = EV + """, l as (select symbol, max(bar_id) as fin from bars group by symbol), e as (select symbol, i0, least(i1, fin) as i1 from ev join l using (symbol)),
c as (select b.symbol, b.bar_id, count(*) as held from bars b join e on e.symbol = b.symbol and b.bar_id between e.i0 and e.i1 group by b.symbol, b.bar_id),
u as (select e.symbol, e.i0, e.i1, avg(1.0::double / held) as weight from e join c on c.symbol = e.symbol and c.bar_id between e.i0 and e.i1 group by e.symbol, e.i0, e.i1)"""


@query("b4_uniqueness", _WEIGHT + " select symbol, i0, i1, round(weight, 6) as weight from u")
def b4(t):
    return uniqueness(falling(t), t.bars).withColumn("weight", F.round("weight", 6))


@query("b5_sample_weights", _WEIGHT + ", v as (select *, sum(weight) over (partition by symbol) as total, sum(weight) over (partition by symbol order by i0) as s from u) select symbol, i0, round(greatest(1 - 0.5 / total * total + 0.5 / total * s, 0), 6) as decay from v")
def b5(t):
    return time_decay(uniqueness(falling(t), t.bars), 0.5).select("symbol", "i0", F.round("decay", 6).alias("decay"))


@query("m1_report", f"""with {TRADES_SQL}, x as (select *, exp(lret) - 1 as x from trades)
select symbol, round(avg(case when lret <> 0 then lret end) / stddev_samp(case when lret <> 0 then lret end) * sqrt(count(case when lret <> 0 then 1 end)), 6) as zscore,
  round(case when max(x) <= 0 then -1 when min(x) >= 0 then 1 else avg((x > 0)::int) - (1 - avg((x > 0)::int)) * -avg(case when x < 0 then x end) / avg(case when x > 0 then x end) end, 6) as kelly,
  round(sum(case when lret > 0 then lret end) / -sum(case when lret < 0 then lret end), 6) as profit_factor from x group by symbol""")  # fmt: skip
def m1(t):
    return trades_of(t).groupBy("symbol").agg(F.round(M.zscore("lret"), 6).alias("zscore"), F.round(M.kelly("lret"), 6).alias("kelly"), F.round(M.profit_factor("lret"), 6).alias("profit_factor"))


@query("m4_drawdown", f"with {TRADES_SQL}, c as (select symbol, i0, exp(sum(lret) over (partition by symbol order by i0)) as v from trades), d as (select symbol, v / max(v) over (partition by symbol order by i0) - 1 as dd from c) select symbol, round(abs(min(dd)), 6) as drawdown from d group by symbol")
def m4(t):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("i0").rowsBetween(Window.unboundedPreceding, 0)
    c = trades_of(t).withColumn("v", F.exp(F.sum("lret").over(w)))
    return c.withColumn("dd", F.col("v") / F.max("v").over(w) - 1).groupBy("symbol").agg(F.round(F.abs(F.min("dd")), 6).alias("drawdown"))
