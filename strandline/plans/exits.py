"""Queries of exits, labels and event studies, and of the feature-utility grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.windows import bollinger
from strandline.operators import exits as X
from strandline.operators import grids as G
from strandline.operators import labels as L
from strandline.operators.events import non_overlapping
from strandline.sources.tables import BARS, PAIR

from . import sqltext as S
from .events import _PATH, EV, falling
from .registry import query

_COARSE = """, coarse as (select symbol, bar_id // 4 as bar_id, last(close order by bar_id) as close from bars group by symbol, bar_id // 4 having count(*) = 4)"""


def _coarse(t):
    return t.bars.groupBy("symbol", F.expr("bar_id div 4").alias("bar_id")).agg(F.max_by("close", "bar_id").alias("close"), F.count(F.lit(1)).alias("n")).where("n = 4").drop("n")


def _trail_sql(side: int) -> str:
    top, stop, active, cross = (
        ("max(high)", "top - 0.15::double * u", "top >= p0 + 0.2::double * u", "low <= stop") if side > 0 else ("min(low)", "top + 0.15::double * u", "top <= p0 - 0.2::double * u", "high >= stop")
    )
    return f"""with {BARS}{_COARSE}, e as (select symbol, bar_id as i0, close as p0, 0.1::double * close as u, (bar_id + 1) * 4 - 1 as j0 from coarse where bar_id % 3 = 0),
p as (select e.*, b.bar_id, b.high, b.low, b.close from e join bars b on b.symbol = e.symbol and b.bar_id between e.j0 + 1 and e.j0 + 20),
q as (select *, {top} over (partition by symbol, i0 order by bar_id) as top from p), s as (select *, case when {active} then {stop} end as stop from q),
g as (select symbol, i0, any_value(p0) as p0, any_value(u) as u, any_value(j0) as j0, min(case when high > p0 + 4 * u then bar_id end) as ju, min(case when low < p0 - 4 * u then bar_id end) as jl, min(case when {cross} then bar_id end) as jt,
  arg_min(case when {cross} then stop end, case when {cross} then bar_id end) as stop, max(case when bar_id = j0 + 20 then close end) as pe from s group by symbol, i0),
h as (select *, case when pe is not null then j0 + 20 end as je from g), k as (select *, least(ju, jl, jt, je) as j1 from h),
m as (select *, case when j1 is null then null when j1 = ju then 'up' when j1 = jl then 'down' when j1 = je then 'expiry' else 'trail' end as touch from k)
select symbol, i0, j1, touch, round(case touch when 'up' then p0 + 4 * u when 'down' then p0 - 4 * u when 'expiry' then pe when 'trail' then stop end, 6) as p1 from m"""


for _side, _n in ((1, "l3_trailing_long"), (-1, "l3_trailing_short")):

    @query(_n, _trail_sql(_side))
    def l3(t, side=_side):
        e = _coarse(t).where("bar_id % 3 = 0").select("symbol", F.col("bar_id").alias("i0"), F.col("close").alias("p0"), (F.lit(0.1) * F.col("close")).alias("unit"))
        return X.trailing_barriers(e, t.bars, 4, 4.0, 4.0, 5, 0.2, 0.15, side=side).select("symbol", "i0", "j1", "touch", F.round("p1", 6).alias("p1"))


@query("l4_absolute_widths", EV + _PATH.format(a="+ 1", b="+ 10") + """, g as (select symbol, i0, any_value(p0) as p0, any_value(vol) * 100 as w, min(case when high > p0 + vol * 100 then bar_id end) as iu, min(case when low < p0 - vol * 100 then bar_id end) as il, max(case when step = 10 then close end) as pe from p group by symbol, i0),
h as (select *, case when iu is not null and (il is null or iu <= il) then p0 + w when il is not null then p0 - w else pe end as p1 from g)
select symbol, i0, round(-ln(case when p1 > 0 then p1 end / p0), 9) as lret from h where p1 is not null and p1 > 0""")  # fmt: skip
def l4(t):
    """Absolute widths, short side, log returns."""
    e = falling(t).withColumn("width", F.col("vol") * 100)
    out = L.range_barriers(e, t.bars, 10, 1.0, 1.0, "width").join(e.select("symbol", "i0", "p0"), ["symbol", "i0"])
    return out.where("p1 > 0").select("symbol", "i0", F.round(-F.ln(F.col("p1") / F.col("p0")), 9).alias("lret"))


def _own_expiry(side: int) -> str:
    top, hit, trail = ("max(close)", "close <= exp(-vol) * p0", "top >= exp(vol) * p0 and top - close >= abs(exp(-vol * 0.5) - 1) * p0") if side > 0 else ("min(close)", "close >= exp(vol) * p0", "top <= exp(-vol) * p0 and close - top >= abs(exp(-vol * 0.5) - 1) * p0")
    return EV.replace("bar_id + 10 as i1", "bar_id + 3 + bar_id % 9 as i1") + f""", p as (select e.*, b.bar_id, b.close from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 and e.i1),
q as (select *, {top} over (partition by symbol, i0 order by bar_id) as top from p)
select symbol, i0, coalesce(min(case when bar_id > i0 and (({hit}) or ({trail})) then bar_id end), max(bar_id)) as i1 from q group by symbol, i0"""


for _side, _n in ((1, "l6_own_expiry_long"), (-1, "l6_own_expiry_short")):

    @query(_n, _own_expiry(_side))
    def l6(t, side=_side):
        return X.trailing_to(falling(t).withColumn("i1", F.col("i0") + 3 + F.col("i0") % 9), t.bars, 1.0, 1.0, 0.5, 11, side=side)


@query("l9_labels", EV + " select e.symbol, e.i0, e.i1, e.p0, b.close as p1, round(-(b.close / e.p0 - 1) - 0.002, 9) as ret, (-sign(b.close / e.p0 - 1))::bigint as bin from ev e join bars b on b.symbol = e.symbol and b.bar_id = e.i1")
def l9(t):
    return X.labelled(falling(t), t.bars, 10, 0.001, short=True).withColumn("ret", F.round("ret", 9))


_PAIRED = f"with {PAIR}, z as (select *, ln(y) - ln(x) as s, ln(y / x) as lr from pair), e as (select a.bar_id as i0, a.y as y0, a.x as x0, b.y as y1, b.x as x1, 0.2::double + a.bar_id % 3 as vol from z a join z b on b.bar_id = a.bar_id + 6 where a.bar_id % 4 = 0), r as (select i0, vol, ln(1 + (y1 / y0 - 0.001 - 1)) + ln(1 + (1 - x1 / x0 - 0.001) * 0.01) as lret from e where 1 + (1 - x1 / x0 - 0.001) * 0.01 > 0)"


@query("l13_pair_legs", _PAIRED + " select i0, round(lret, 9) as lret, round(ln(1 + (exp(lret) - 1) / (vol / 0.9)), 9) as target, round(ln(1 + (exp(lret) - 1) / greatest(vol / 0.9, 1)), 9) as capped from r where 1 + (exp(lret) - 1) / (vol / 0.9) > 0")
def l13(t):
    a = t.pair.where("bar_id % 4 = 0").select(F.col("bar_id").alias("i0"), F.col("y").alias("y0"), F.col("x").alias("x0"), (F.lit(0.2) + F.col("bar_id") % 3).alias("vol"))
    e = a.join(t.pair.select((F.col("bar_id") - 6).alias("i0"), F.col("y").alias("y1"), F.col("x").alias("x1")), "i0")
    lret = X.log_return(F.col("y0"), F.col("y1"), 0.001) + X.log_return(F.col("x0"), F.col("x1"), 0.001, 0.01, short=True)
    r = e.select("i0", "vol", lret.alias("lret")).where("lret is not null")
    r = r.select("i0", F.round("lret", 9).alias("lret"), F.round(X.levered(F.col("lret"), F.col("vol"), target=0.9), 9).alias("target"), F.round(X.levered(F.col("lret"), F.col("vol"), most=0.9), 9).alias("capped"))
    return r.where("target is not null")


@query("l14_event_study", f"""with {BARS}, e as (select symbol, time + interval 30 minute as time from bars where bar_id % 11 = 3), a as (select e.symbol, e.time, b.bar_id as i0, b.open as p0 from e asof join bars b on b.symbol = e.symbol and e.time > b.time)
select a.symbol, a.time, hold::int as hold, round_even(max(case when b.bar_id = i0 + hold then close end) / p0 - 1, 3) as ret, round_even(min(low) / p0 - 1, 3) as low, round_even(max(high) / p0 - 1, 3) as high from a, (values (1), (6), (24)) h(hold) join bars b on b.symbol = a.symbol and b.bar_id between i0 + 1 and i0 + hold group by a.symbol, a.time, p0, i0, hold having max(case when b.bar_id = i0 + hold then 1 end) = 1""")  # fmt: skip
def l14(t):
    return X.event_returns(t.bars.where("bar_id % 11 = 3").select("symbol", (F.col("time") + F.expr("interval 30 minutes")).alias("time")), t.bars, [1, 6, 24])


@query("l15_announced", f"""with {BARS}, e as (select symbol, time as announced, time + ((bar_id % 5) * 10)::int * interval 1 hour as start from bars where bar_id % 9 = 4), f as (select *, greatest(announced, start - interval 24 hour) as t0 from e),
g as (select f.*, b.close as p0 from f asof join bars b on b.symbol = f.symbol and f.t0 >= b.time) select g.symbol, announced, start, round(b.close / p0 - 1, 9) as ret from g asof join bars b on b.symbol = g.symbol and g.start >= b.time""")  # fmt: skip
def l15(t):
    e = t.bars.where("bar_id % 9 = 4").select("symbol", F.col("time").alias("announced"), (F.col("time") + F.make_dt_interval(hours=(F.col("bar_id") % 5 * 10).cast("int"))).alias("start"))
    return X.announced_returns(e, t.bars).withColumn("ret", F.round("ret", 9))


_THR, _DAYS = (-1.5, -1.0, -0.5, 0.5, 1.0), 30.0
_Z = [{"lc": "ln(close)"}, {"z": S.z("lc", 20)}, {"zp": "lag(z) over o"}]
_GRID = f", (values {', '.join(f'({v}::double)' for v in _THR)}) g(thr)"
_OUT = ("utility", "sharpe", "annual", "zscore", "freq", "hours", "sharpe_freq")
#: From trades(symbol, thr, t0, t1, lret) to the measures.
_SUMMED = """, daily as (select symbol, thr, t0::date as day, sum(lret) as r from trades group by all), ds as (select symbol, thr, sum(r) as total, sum(r * r) as square, {days} as days from daily {zero} group by symbol, thr),
ts as (select symbol, thr, avg(lret) / nullif(stddev_samp(lret), 0) * sqrt(count(*)) as zscore, count(*) as n, median(epoch_us(t1) - epoch_us(t0)) / 3.6e9 as hours from trades group by symbol, thr),
fin as (select *, total / nullif(sqrt(square), 0) * sqrt(365.0::double / 30) as sharpe from ds join ts using (symbol, thr) where days > 5)
select symbol, thr, round(total * greatest(0, least(6, sharpe)) * 365 / 30, 6) as utility, round(sharpe, 6) as sharpe, round(total * 365 / 30, 6) as annual, round(zscore, 6) as zscore, round(n * 365.0::double / 30, 6) as freq, round(hours, 6) as hours, round(n * 365.0::double / 30 * greatest(0, least(6, sharpe)), 6) as sharpe_freq from fin"""


def _summed(zero: bool = False) -> str:
    return _SUMMED.format(days="datediff('day', min(day), max(day)) + 1" if zero else "count(*)", zero="" if zero else "where r <> 0")


def _kept(ret: str) -> str:
    """From ev(symbol, thr, t0, i0, p0, i1) to trades: greedy without overlap."""
    return f""", nx as materialized (select a.symbol, a.thr, a.i0, a.i1, min(b.i0) as nxt from ev a left join ev b on b.symbol = a.symbol and b.thr = a.thr and b.i0 >= a.i1 and b.i0 > a.i0 group by all),
kept as (select symbol, thr, min(i0) as i0 from ev group by symbol, thr union all select k.symbol, k.thr, nx.nxt from kept k join nx on nx.symbol = k.symbol and nx.thr = k.thr and nx.i0 = k.i0 where nx.nxt is not null),
trades as (select ev.symbol, ev.thr, ev.t0, b.time as t1, ln(1 + {ret}) as lret from ev join kept using (symbol, thr, i0) join bars b on b.symbol = ev.symbol and b.bar_id = ev.i1)"""


def _grid_sql(tail: str) -> str:
    return S.steps(BARS, "bars", _Z, "", "").split("\nselect")[0] + tail


def _rounded(df):
    return df.select("symbol", "thr", *[F.round(c, 6).alias(c) for c in _OUT])


def _z(t):
    return t.bars.withColumn("z", bollinger("close", 20))


_CROSS = f", cr as (select symbol, thr, time as t0, bar_id as i0, close as p0, 0.1::double + (bar_id % 5) * 0.1::double as vol from step2{_GRID} where z >= thr and zp < thr)"


@query("g1_utility", _grid_sql(_CROSS + ", l as (select symbol, max(bar_id) as fin from bars group by symbol), ev as materialized (select cr.*, least(i0 + 6, fin) as i1 from cr join l using (symbol))" + _kept("(b.close / ev.p0 - 1 - 0.001) * 0.5") + _summed()))
def g1(t):
    return _rounded(G.utility_grid(_z(t), "z", _THR, 6, _DAYS, leverage=0.5))


@query("g2_utility_barriers", _grid_sql(_CROSS + """, pp as (select e.*, b.bar_id, b.close, b.bar_id - e.i0 as step from (select distinct symbol, i0, p0, vol from cr) e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 and e.i0 + 10),
gg as (select symbol, i0, min(case when ln(close / p0) >= vol and step > 0 then step end) as tp, min(case when ln(close / p0) <= -vol and step > 0 then step end) as sl, max(bar_id) as fin from pp group by symbol, i0),
ev as materialized (select cr.*, least(cr.i0 + coalesce(least(tp, sl), 10), fin) as i1 from cr join gg on gg.symbol = cr.symbol and gg.i0 = cr.i0)""" + _kept("(b.close / ev.p0 - 1 - 0.001) * 0.5 - 0.001") + _summed()))  # fmt: skip
def g2(t):
    vol = F.lit(0.1) + (F.col("bar_id") % 5) * F.lit(0.1)
    exits = lambda e: L.close_barriers(e, t.bars, 10, 1.0, 1.0).select("symbol", "i0", "i1")
    return _rounded(G.utility_grid(_z(t).withColumn("vol", vol), "z", _THR, 10, _DAYS, leverage=0.5, extra=0.001, exits=exits))


_DYNAMIC = """, sig as (select symbol, thr, time, bar_id, 0 as kind from {base} where {enter} union all select symbol, thr, time, bar_id, 1 from {base} where {leave}),
sig1 as (select *, lag(kind) over (partition by symbol, thr order by bar_id, kind) as before from sig),
sig2 as (select *, lead(time) over (partition by symbol, thr order by bar_id, kind) as t1, lead(bar_id) over (partition by symbol, thr order by bar_id, kind) as i1 from sig1 where before is null or before <> kind),
ev as (select symbol, thr, time as t0, bar_id as i0, t1, i1 from sig2 where kind = 0 and t1 is not null)"""


@query("g4_utility_dynamic", _grid_sql(f", gz as (select * from step2{_GRID})" + _DYNAMIC.format(base="gz", enter="z <= thr and zp > thr", leave="z >= 0 and zp < 0") + """,
trades as (select ev.symbol, ev.thr, t0, t1, ln(1 + (b.close / a.close - 0.001 - 1) * 0.5) as lret from ev join bars a on a.symbol = ev.symbol and a.bar_id = ev.i0 join bars b on b.symbol = ev.symbol and b.bar_id = ev.i1)""" + _summed(True)))  # fmt: skip
def g4(t):
    e = G.dynamic_exits(_z(t), "z", _THR, 0.0, entry_up=False, exit_up=True)
    b = t.bars.select("symbol", "bar_id", "close")
    e = e.join(b.select("symbol", F.col("bar_id").alias("i0"), F.col("close").alias("p0")), ["symbol", "i0"]).join(b.select("symbol", F.col("bar_id").alias("i1"), F.col("close").alias("p1")), ["symbol", "i1"])
    return _rounded(G.summed_up(e.withColumn("lret", X.log_return(F.col("p0"), F.col("p1"), 0.001, 0.5)), _DAYS, keep_zero=True))


@query("g3_utility_pair", S.steps(PAIR, "pair", [{"s": "ln(y) - ln(x)"}, {"z": S.z("s", 20)}, {"zp": "lag(z) over o"}], "", "").split("\nselect")[0] + f", gz as (select * from step2{_GRID})" + _DYNAMIC.format(base="gz", enter="z <= thr and zp > thr", leave="z >= 0 and zp < 0") + """,
trades as (select ev.symbol, ev.thr, t0, ev.t1, ln(1 + (b.y / a.y - 0.001 - 1) * 0.5) + ln(1 + (1 - b.x / a.x - 0.001) * 0.01) as lret from ev join pair a on a.bar_id = ev.i0 join pair b on b.bar_id = ev.i1 where 1 + (1 - b.x / a.x - 0.001) * 0.01 > 0)""" + _summed())  # fmt: skip
def g3(t):
    from strandline.functions.windows import zscore

    p = t.pair.withColumn("z", zscore(F.ln("y") - F.ln("x"), 20))
    e = G.dynamic_exits(p, "z", _THR, 0.0, entry_up=False, exit_up=True)
    b = t.pair.select("bar_id", "y", "x")
    e = e.join(b.select(F.col("bar_id").alias("i0"), F.col("y").alias("y0"), F.col("x").alias("x0")), "i0").join(b.select(F.col("bar_id").alias("i1"), F.col("y").alias("y1"), F.col("x").alias("x1")), "i1")
    lret = X.log_return(F.col("y0"), F.col("y1"), 0.001, 0.5) + X.log_return(F.col("x0"), F.col("x1"), 0.001, 0.01, short=True)
    return _rounded(G.summed_up(e.withColumn("lret", lret).where("lret is not null"), _DAYS))
