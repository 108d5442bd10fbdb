"""Queries of signal tables and strategies, and of the other forms of operators that the plain queries leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.windows import bollinger, div, order
from strandline.operators import signals as G
from strandline.operators.events import non_overlapping
from strandline.operators.labels import bins, close_barriers
from strandline.operators.paths import as_of, in_reach
from strandline.operators.thresholds import find_threshold
from strandline.sources.tables import BARS, TICKS

from . import sqltext as S
from .events import _PATH, EV, falling
from .flagship import TRADES_SQL, trades_of
from .registry import query

_ZS = S.steps(BARS, "bars", [{"lc": "ln(close)"}, {"z": S.z("lc", 20)}, {"zp": "lag(z) over o"}], "", "").split("\nselect")[0]
_LEVELS = (-1.0, 0.0, 1.0)


def _z(t):
    return t.bars.withColumn("z", bollinger("close", 20))


_TH = ", th as (select symbol, avg(z) + l * stddev_samp(z) as thr from step2, (values (-1.0::double), (0.0::double), (1.0::double)) v(l) group by symbol, l)"


@query("z2_thresholds_zscore", _ZS + _TH + " select symbol, round(thr, 6) as thr from th")
def z2(t):
    return G.thresholds(_z(t), "z", "zscore", _LEVELS).select("symbol", F.round("thr", 6).alias("thr"))


@query("z2_thresholds_percentile", _ZS + ", q as (select symbol, unnest(quantile_cont(z, [0.1, 0.5, 0.9])) as thr from step2 group by symbol) select symbol, round(thr, 6) as thr from q")
def z2b(t):
    return G.thresholds(_z(t), "z", "percentile", (10, 50, 90)).select("symbol", F.round("thr", 6).alias("thr"))


@query("z1_signals_two_way", _ZS + ", g as (select symbol, bar_id, thr, case when z >= thr and zp < thr then 1 when z <= thr and zp > thr then -1 end as side from step2, (values (-1.0::double), (0.0::double), (1.0::double)) v(thr)) select symbol, thr, bar_id, side::int as side from g where side is not null")
def z1(t):
    z = _z(t)
    return G.distinct_signals(G.signal_grid(z, "z", G.thresholds(z, "z", "as_is", _LEVELS), "two_way"))


@query("z1_signals_between", _ZS + ", g as (select symbol, bar_id, case when z >= 1 then 1.0 when z >= 0 then 0.0 when z >= -1 then -1.0 end::double as thr from step2) select symbol, thr, bar_id, 1 as side from g where thr is not null")
def z1b(t):
    z = _z(t)
    return G.signal_grid(z, "z", G.thresholds(z, "z", "as_is", _LEVELS), "between")


@query("z3_time_constraint", "select event_id, isodow(l) < 6 and hour(l) >= 8 and hour(l) < 17 as ok from (select event_id, (ts at time zone 'UTC') at time zone 'America/New_York' as l from events)")
def z3(t):
    return t.read("events").select("event_id", G.time_allowed("ts", "America/New_York").alias("ok"))


@query("z4_resampled", f"with {BARS} select symbol, time_bucket(interval 4 hour, time, timestamp '2000-01-01') as time, arg_min(open, time) as open, max(high) as high, min(low) as low, arg_max(close, time) as close, sum(volume)::bigint as volume from bars b group by symbol, time_bucket(interval 4 hour, time, timestamp '2000-01-01')")
def z4(t):
    return G.resampled(t.bars, 240)


@query("z5_strided_band", f"with {BARS}, v as (select symbol, bar_id, [close, " + ", ".join(f"lag(close, {k * 4}) over o" for k in range(1, 6)) + "] as v, lag(close, 20) over o as last from bars window o as (partition by symbol order by bar_id)), m as (select *, list_avg(v) as mean from v where last is not null) select symbol, bar_id, round((v[1] - mean) / nullif(sqrt(list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / 5), 0), 6) as value from m")
def z5(t):
    return t.bars.select("symbol", "bar_id", F.round(G.strided_zscore("close", 6, 4), 6).alias("value")).where("value is not null")


@query("z5_timeframes", "select v as timeframe, case right(v, 1) when 'm' then 1 when 'h' then 60 when 'd' then 1440 else 10080 end * left(v, -1)::bigint as minutes from (select distinct l_linenumber::varchar || ['m', 'h', 'd', 'w'][l_linenumber % 4 + 1] as v from lineitem)")
def z5b(t):
    unit = F.element_at(F.array(*map(F.lit, "mhdw")), F.col("l_linenumber") % 4 + 1)
    v = t.read("lineitem").select(F.concat(F.col("l_linenumber").cast("string"), unit).alias("timeframe")).distinct()
    return v.select("timeframe", G.minutes_of("timeframe").alias("minutes"))


@query("z6_return_grid", f"with {BARS}, r as (select symbol, bar_id, h::int as horizon, case h when 1 then lead(close, 1) over o when 5 then lead(close, 5) over o else lead(close, 20) over o end / close - 1 as r from bars, (values (1), (5), (20)) v(h) window o as (partition by symbol, h order by bar_id)) select symbol, bar_id, horizon, side::int as side, round(side * r - 0.002, 9) as ret from r, (values (1), (-1)) s(side) where r is not null")
def z6(t):
    return G.return_grid(t.bars, (1, 5, 20), 0.001).withColumn("ret", F.round("ret", 9))


@query("z8_strategy", _ZS + """, sg as (select symbol, bar_id as i0, close as p0, time from step2 where z <= -0.5 and zp > -0.5 and isodow(time) < 6),
nx as materialized (select a.symbol, a.i0, min(b.i0) as nxt from sg a left join sg b on b.symbol = a.symbol and b.i0 >= a.i0 + 5 group by all), kept as (select symbol, min(i0) as i0 from sg group by symbol union all select k.symbol, nx.nxt from kept k join nx on nx.symbol = k.symbol and nx.i0 = k.i0 where nx.nxt is not null)
select sg.symbol, sg.i0, round(ln(b.close / sg.p0), 9) as lret from sg join kept using (symbol, i0) join bars b on b.symbol = sg.symbol and b.bar_id = sg.i0 + 5""")  # fmt: skip
def z8(t):
    """Signal and time constraint, thinned, held for five bars: the trade history of a strategy."""
    z = _z(t).withColumn("zp", F.lag("z").over(order())).where("z <= -0.5 and zp > -0.5").where(F.weekday("time") < 5)
    e = non_overlapping(z.select("symbol", F.col("bar_id").alias("i0"), F.col("close").alias("p0"), (F.col("bar_id") + 5).alias("i1")), "i0", "i1")
    b = t.bars.select("symbol", F.col("bar_id").alias("i1"), F.col("close").alias("p1"))
    return e.join(b, ["symbol", "i1"]).select("symbol", "i0", F.round(F.ln(F.col("p1") / F.col("p0")), 9).alias("lret"))


@query("z9_subperiods", f"with {BARS} select symbol, ntile(5) over (partition by symbol order by bar_id) as part, bar_id, lag(close, 2) over (partition by symbol order by bar_id) as shifted from bars")
def z9(t):
    return t.bars.select("symbol", F.ntile(5).over(order()).cast("long").alias("part"), "bar_id", F.lag("close", 2).over(order()).alias("shifted"))


@query("z10_balance_of_power", S.steps(BARS, "bars", [{"r": "(close - open) / nullif(high - low, 0)", "tp": "(high + low + close) / 3"}, {"m": S.roll("avg", "tp", 14)}], "symbol, bar_id, round(r, 6) as bop, round(" + "case when count(close) over w14 = 14 then regr_slope(close, bar_id) over w14 end" + ", 6) as slope"))
def z10(t):
    from strandline.functions.windows import gate, w

    slope = gate(div(F.regr_sxy("close", "bar_id").over(w(14)), F.regr_sxx("close", "bar_id").over(w(14))), "close", 14)
    return t.bars.select("symbol", "bar_id", F.round(div(F.col("close") - F.col("open"), F.col("high") - F.col("low")), 6).alias("bop"), F.round(slope, 6).alias("slope"))


@query("c5_aligned_outer", f"with {BARS} select coalesce(a.time, b.time) as time, round(a.close / b.close, 9) as ratio from (select * from bars where symbol = 'click') a full join (select * from bars where symbol = 'view') b on a.time = b.time")
def c5(t):
    a, b = (t.bars.where(F.col("symbol") == s).select("time", F.col("close").alias(c)) for s, c in (("click", "a"), ("view", "b")))
    return a.join(b, "time", "full").select("time", F.round(F.col("a") / F.col("b"), 9).alias("ratio"))


@query("c16_three_venues", f"with {TICKS}, a as (select distinct symbol from ticks where qty > 50), b as (select distinct symbol from ticks where price > 100), c as (select distinct symbol from ticks where id % 3 = 0) select symbol from a intersect select symbol from b intersect select symbol from c")
def c16(t):
    a, b, c = (t.ticks.where(w).select("symbol").distinct() for w in ("qty > 50", "price > 100", "id % 3 = 0"))
    return a.join(b, "symbol", "left_semi").join(c, "symbol", "left_semi")


@query("c25_added_margin", f"with {BARS} select symbol, bar_id, round((close * (1 - 0.1::double) - 50) * 1.005::double, 6) as price from bars")
def c25(t):
    """A long position's liquidation price after margin of 50 a unit has been added."""
    from strandline.operators.cleaning import liquidation_price

    return t.bars.select("symbol", "bar_id", F.round(liquidation_price("close", 10, added=50.0), 6).alias("price"))


@query("e1_outward", _ZS + ", g as (select symbol, bar_id, thr, case when thr >= 0 then z >= thr and zp < thr else z <= thr and zp > thr end as hit, volume from step2, (values (-1.0::double), (1.0::double)) v(thr)) select symbol, thr, bar_id from g where hit and not coalesce(volume < 100, false)")
def e1(t):
    from strandline.operators.grids import crosses, on_grid

    g = on_grid(_z(t), "z", (-1.0, 1.0))
    hit = F.when(F.col("thr") >= 0, crosses("z", F.col("thr"), True)).otherwise(crosses("z", F.col("thr"), False))
    return g.where(hit & ~F.coalesce(F.col("volume") < 100, F.lit(False))).select("symbol", "thr", "bar_id")


_FINE = [round(0.2 + 0.05 * k, 2) for k in range(37)]


@query("e6_threshold_by_month", _ZS + f", g as (select *, lag(z >= thr) over (partition by symbol, thr order by bar_id) as was from step2, (values {', '.join(f'({v}::double)' for v in _FINE)}) v(thr)), s as (select symbol, thr, bar_id, time, coalesce(z >= thr and not was, false)::int as sg from g), q as (select *, sum(sg) over w as near, count(*) over w as c from s window w as (partition by symbol, thr order by bar_id rows between 3 preceding and 1 preceding)), n as (select symbol, thr, sum(case when sg = 1 and near = 0 and c = 3 then 1 else 0 end) / ((epoch_us(max(time)) - epoch_us(min(time))) / (30.4375 * 86400e6)) as per_month from q group by symbol, thr) select symbol, arg_min(thr, {{'a': round(abs(per_month - 12), 9), 'b': thr}}) as thr from n group by symbol")
def e6(t):
    """The threshold whose signals, none within three bars of another, come nearest to twelve a month: one grid in one plan in place of a search."""
    by = Window.partitionBy("symbol", "thr").orderBy("bar_id")
    g = _z(t).select("symbol", "bar_id", "time", "z", F.explode(F.array(*map(F.lit, _FINE))).alias("thr"))
    g = g.withColumn("sg", F.coalesce((F.col("z") >= F.col("thr")) & ~F.lag(F.col("z") >= F.col("thr")).over(by), F.lit(False)).cast("int"))
    near = by.rowsBetween(-3, -1)
    g = g.withColumn("ok", (F.col("sg") == 1) & (F.sum("sg").over(near) == 0) & (F.count(F.lit(1)).over(near) == 3))
    micros = F.unix_micros(F.max("time").cast("timestamp")) - F.unix_micros(F.min("time").cast("timestamp"))
    n = g.groupBy("symbol", "thr").agg((F.count(F.when(F.col("ok"), 1)) / (micros / (30.4375 * 86400e6))).alias("per_month"))
    return n.groupBy("symbol").agg(F.min_by("thr", F.struct(F.round(F.abs(F.col("per_month") - 12), 9).alias("a"), "thr")).alias("thr"))


def _search_sql(lower: bool) -> str:
    """Every value of the feature is tried as a threshold, bar by bar."""
    sign = "-" if lower else ""
    return (
        _ZS
        + f""", x as (select symbol, bar_id, time, {sign}round(z, 6) as x from step2),
a as (select symbol, floor((epoch_us(max(time)) - epoch_us(min(time))) / 86400e6) / 30 * 12 as target, quantile_cont(x, 0.5) as median from x group by symbol),
th as (select distinct x.symbol, x.x as thr from x join a on a.symbol = x.symbol where x.x >= a.median),
g as (select th.symbol, th.thr, x.bar_id, coalesce(x.x >= th.thr and lag(x.x) over (partition by th.symbol, th.thr order by x.bar_id) < th.thr, false)::int as sg from th join x on x.symbol = th.symbol),
q as (select *, sum(sg) over w as near, count(*) over w as c from g window w as (partition by symbol, thr order by bar_id rows between 3 preceding and 1 preceding)),
n as (select symbol, thr, sum(case when sg = 1 and near = 0 and c = 3 then 1 else 0 end)::bigint as signals from q group by symbol, thr),
r as (select n.*, a.target, row_number() over (partition by n.symbol order by round(abs(signals - a.target), 9), thr) as k from n join a on a.symbol = n.symbol where a.target > 0)
select symbol, {sign}thr as threshold, signals, target from r where k = 1"""
    )


@query("e6_threshold_search", _search_sql(False))
def e6_search(t):
    return find_threshold(_z(t).withColumn("z", F.round("z", 6)), "z", 12)


@query("e6_threshold_search_lower", _search_sql(True))
def e6_search_lower(t):
    return find_threshold(_z(t).withColumn("z", F.round("z", 6)), "z", 12, lower=True)


@query("p7_own_interval", EV.replace("bar_id + 10 as i1", "bar_id + 3 + bar_id % 9 as i1") + " select e.symbol, e.i0, count(*) as n, max(b.high) as top, round(avg(b.close), 6) as mean from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 and e.i1 group by e.symbol, e.i0")
def p7(t):
    e = falling(t).withColumn("i1", F.col("i0") + 3 + F.col("i0") % 9)
    p = in_reach(e, t.bars.select("symbol", "bar_id", "close", "high"), 0, 11).where("bar_id <= i1")
    return p.groupBy("symbol", "i0").agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("top"), F.round(F.avg("close"), 6).alias("mean"))


@query("p8_entry_and_exits", f"with {BARS}, l as (select user_id, event_type as symbol, min(ts) as time from events group by user_id, event_type), e as (select l.*, b.close as p0, l.time + interval 6 hour as at from l asof join bars b on b.symbol = l.symbol and l.time >= b.time) select e.user_id, e.symbol, round(b.close / p0 - 1, 9) as ret from e asof join bars b on b.symbol = e.symbol and e.at <= b.time")
def p8(t):
    first = t.read("events").groupBy("user_id", F.col("event_type").alias("symbol")).agg(F.min("ts").alias("time"))
    e = as_of(first, t.bars.select("symbol", "time", "close")).where("close_r is not null")
    e = e.select("user_id", "symbol", F.col("close_r").alias("p0"), (F.col("time") + F.expr("interval 6 hours")).alias("time"))
    x = as_of(e, t.bars.select("symbol", "time", "close"), forward=True).where("close_r is not null")
    return x.select("user_id", "symbol", F.round(F.col("close_r") / F.col("p0") - 1, 9).alias("ret"))


@query("l1_close_barriers_short", EV + _PATH.format(a="", b="+ 10") + """, g as (select symbol, i0, min(case when -ln(close / p0) >= vol and step > 0 then step end) as tp, min(case when -ln(close / p0) <= -vol and step > 0 then step end) as sl, max(bar_id) as fin from p group by symbol, i0)
select symbol, i0, least(i0 + coalesce(least(tp, sl), 10), fin) as i1, case when tp <= coalesce(sl, 11) then 'up' when sl is not null then 'down' else 'expiry' end as touch from g""")  # fmt: skip
def l1(t):
    return close_barriers(falling(t), t.bars, 10, 1.0, 1.0, side=-1)


@query("l8_bins_short", EV + " select e.symbol, e.i0, round(ln(1 + -(b.close / e.p0 - 1) - 0.002), 9) as lret, (-sign(b.close / e.p0 - 1))::bigint as bin from ev e join bars b on b.symbol = e.symbol and b.bar_id = e.i1 where 1 - (b.close / e.p0 - 1) - 0.002 > 0")
def l8(t):
    ret, bin_ = bins(F.col("p0"), F.col("p1"), 0.001, short=True)
    p1 = t.bars.select("symbol", F.col("bar_id").alias("i1"), F.col("close").alias("p1"))
    return falling(t).join(p1, ["symbol", "i1"]).select("symbol", "i0", F.round(F.log1p(ret), 9).alias("lret"), bin_.alias("bin")).where("lret is not null")


@query("l10_horizon_returns_short", f"with {BARS} select symbol, bar_id, round(ln(1 - (lead(close, 5) over (partition by symbol order by bar_id) / close - 1) - 0.002), 9) as lret from bars qualify 1 - (lead(close, 5) over (partition by symbol order by bar_id) / close - 1) - 0.002 > 0")
def l10(t):
    r = F.log1p(-(F.lead("close", 5).over(order()) / F.col("close") - 1) - 0.002)
    return t.bars.select("symbol", "bar_id", F.round(r, 9).alias("lret")).where("lret is not null")


@query("m2_sharpe_by_month", f"with {TRADES_SQL}, d as (select symbol, t1::date as day, sum(lret) as r from trades group by symbol, t1::date having sum(lret) <> 0) select symbol, date_trunc('week', day)::timestamp as period, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365.0::double), 6) as sharpe, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)), 6) as zscore from d group by symbol, period")
def m2(t):
    d = trades_of(t).groupBy("symbol", F.to_date("t1").alias("day")).agg(F.sum("lret").alias("r")).where("r <> 0")
    ratio = div(F.avg("r"), F.stddev_samp("r"))
    return d.groupBy("symbol", F.date_trunc("week", "day").cast("timestamp_ntz").alias("period")).agg(F.round(ratio * 365.0**0.5, 6).alias("sharpe"), F.round(ratio * F.sqrt(F.count(F.lit(1)).cast("double")), 6).alias("zscore"))


@query("m11_profit_factor_daily", f"with {TRADES_SQL}, d as (select symbol, t1::date as day, sum(lret) as r from trades group by symbol, t1::date) select symbol, round(sum(case when r > 0 then r end) / nullif(-sum(case when r < 0 then r end), 0), 6) as factor from d group by symbol")
def m11(t):
    from strandline.functions.metrics import profit_factor

    d = trades_of(t).groupBy("symbol", F.to_date("t1").alias("day")).agg(F.sum("lret").alias("r"))
    return d.groupBy("symbol").agg(F.round(profit_factor("r"), 6).alias("factor"))


@query("m12_return_bins", S.steps(BARS, "bars", [{"lc": "ln(close)"}, {"z": S.z("lc", 20), "r": "ln(lead(close) over o / close)"}], "symbol, (ceil(z * 2) / 2 - 0.5)::double as lower, count(*) as n, round(median(r), 6) as median, round(avg(r), 6) as mean", "where z is not null and r is not null group by symbol, lower"))
def m12(t):
    b = t.bars.select("symbol", bollinger("close", 20).alias("z"), F.ln(F.lead("close").over(order()) / F.col("close")).alias("r")).where("z is not null and r is not null")
    return b.groupBy("symbol", (F.ceil(F.col("z") * 2) / 2 - 0.5).alias("lower")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("r"), 6).alias("median"), F.round(F.avg("r"), 6).alias("mean"))
