"""Queries of feature sets, levels, premiums, encodings, measures by block, bootstrap tables and classification scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import metrics as M
from strandline.functions.windows import atr, bollinger, div, gate, lag, order, sma, w
from strandline.operators import encodings as E
from strandline.operators import levels as V
from strandline.operators.bootstrap import block_indices, recency_weights, stair_weights
from strandline.operators.paths import as_of, last_rows, ols, path
from strandline.sources.tables import BARS, PAIR, TICKS

from . import sqltext as S
from .events import _PATH, EV, falling
from .flagship import TRADES_SQL, trades_of
from .registry import query


@query("w15_cross_rate", S.steps(BARS + ", pr as (select 'click/view' as symbol, a.time, a.close, a.high, a.low, b.close as other, row_number() over (order by a.time) - 1 as bar_id from bars a join bars b on a.time = b.time and a.symbol = 'click' and b.symbol = 'view')", "pr", [{"fx": S.roll("avg", "other", 10) + " / " + S.roll("avg", "close", 10), "pc": "lag(close) over o"}, {"tr": "case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end"}], "bar_id, round((close - fx * close) / nullif(" + S.roll("avg", "tr", 10) + ", 0), 6) as value"))
def w15(t):
    a = t.bars.where("symbol = 'click'").select("time", "close", "high", "low")
    b = t.bars.where("symbol = 'view'").select("time", F.col("close").alias("other"))
    p = a.join(b, "time").withColumn("symbol", F.lit("click/view")).withColumn("bar_id", F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1)
    fx = sma("other", 10) / sma("close", 10)
    return p.select("bar_id", F.round(div(F.col("close") - fx * F.col("close"), atr(10)), 6).alias("value"))


@query("w20_path_atr", EV + ", g as (select e.symbol, e.i0, (b.bar_id - e.i0 + 9) // 2 as step, max(ln(high)) as h, min(ln(low)) as l, count(*) as n from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 - 9 and e.i0 group by all) select symbol, i0, round(avg(h - l), 6) as value from g where n = 2 group by symbol, i0")
def w20(t):
    e, b = falling(t), t.bars.select("symbol", "bar_id", F.ln("high").alias("h"), F.ln("low").alias("l"))
    hi, lo = (path(e, b, c, 5, 2, how).withColumnRenamed("value", c) for c, how in (("h", "max"), ("l", "min")))
    return hi.join(lo, ["symbol", "i0", "step"]).where("h is not null").groupBy("symbol", "i0").agg(F.round(F.avg(F.col("h") - F.col("l")), 6).alias("value"))


def _nearest(below: bool) -> str:
    f, op, side, way = ("min", ">=", "<", "desc") if below else ("max", "<=", ">", "asc")
    return EV + f""", pv as (select symbol, bar_id, close from bars window a as (partition by symbol order by bar_id rows between 3 preceding and 1 preceding), b as (partition by symbol order by bar_id rows between 1 following and 3 following) qualify count(*) over a = 3 and count(*) over b = 3 and {f}(close) over a {op} close and {f}(close) over b {op} close),
j as (select e.symbol, e.i0, e.p0, pv.close, row_number() over (partition by e.symbol, e.i0 order by pv.close {way}, pv.bar_id) as n from ev e join pv on pv.symbol = e.symbol and pv.bar_id between e.i0 - 60 and e.i0 - 3 and pv.close {side} e.p0)
select symbol, i0, round(abs(ln(avg(close) / any_value(p0))), 6) as value from j where n <= 3 group by symbol, i0"""


for _below, _n in ((True, "w22_support_distance"), (False, "w22_resistance_distance")):

    @query(_n, _nearest(_below))
    def w22(t, below=_below):
        return V.nearest_levels(falling(t), t.bars, 60, 3, 3, below).withColumn("value", F.round("value", 6))


def _norm_sql(below: bool) -> str:
    side, way = ("<", "desc") if below else (">", "asc")
    pivot = " or ".join(f"({f}(close) over a {op} close and {f}(close) over b {op} close)" for f, op in (("min", ">="), ("max", "<=")))
    return EV + f""", pv as (select symbol, bar_id, close from bars window a as (partition by symbol order by bar_id rows between 3 preceding and 1 preceding), b as (partition by symbol order by bar_id rows between 1 following and 3 following) qualify count(*) over a = 3 and count(*) over b = 3 and ({pivot})),
sd as (select symbol, bar_id, case when count(close) over w = 60 then stddev_samp(ln(close)) over w end as sd from bars window w as (partition by symbol order by bar_id rows between 59 preceding and current row)),
j as (select e.symbol, e.i0, e.p0, pv.close, row_number() over (partition by e.symbol, e.i0 order by pv.close {way}, pv.bar_id) as n from ev e join pv on pv.symbol = e.symbol and pv.bar_id between e.i0 - 60 and e.i0 - 3 and pv.close {side} e.p0),
g as (select symbol, i0, abs(ln(avg(close) / any_value(p0))) as v from j where n <= 3 group by symbol, i0)
select g.symbol, g.i0, round(v / nullif(sd, 0), 6) as value from g join sd on sd.symbol = g.symbol and sd.bar_id = g.i0"""


for _below, _n in ((True, "w22_support_both_norm"), (False, "w22_resistance_both_norm")):

    @query(_n, _norm_sql(_below))
    def w22_norm(t, below=_below):
        return V.nearest_levels(falling(t), t.bars, 60, 3, 3, below, both=True, norm=True).withColumn("value", F.round("value", 6))


@query("w23_level_ratio")
def w23(t):
    sd = path(falling(t), t.bars.withColumn("lc", F.ln("close")), "lc", 20).groupBy("symbol", "i0").agg(F.stddev_pop("value").alias("value"))
    return V.level_ratio(falling(t), t.bars, sd.where("value > 0"), 120, 3).withColumn("value", F.round("value", 6))


@query("w24_between_levels")
def w24(t):
    return V.between_levels(path(falling(t), t.bars, "close", 30), 20.0).withColumn("value", F.round("value", 6))


def _set_sql(x: str, log: bool) -> str:
    return _PATH.format(a="- 11", b="").replace("b.close, b.high, b.low,", f"{x} as v,") + f""", q as (select *, {'ln(v / lag(v) over o)' if log else 'v - lag(v) over o'} as r from p window o as (partition by symbol, i0 order by bar_id))
select symbol, i0, round(sum(r) / nullif(sqrt(sum(r * r)), 0), 6) as sharpe1, round(sum(r) / nullif(stddev_samp(r), 0), 6) as sharpe2, round(sum(r), 6) as returns, round(stddev_samp(r), 6) as std, round(sqrt(sum(r * r)), 6) as vol from q group by symbol, i0"""


def _set(p, log: bool):
    by = Window.partitionBy("symbol", "i0").orderBy("step")
    before = F.lag("value").over(by)
    r = p.withColumn("r", F.ln(F.col("value") / before) if log else F.col("value") - before)
    root = F.sqrt(F.sum(F.col("r") * F.col("r")))
    out = {"sharpe1": div(F.sum("r"), root), "sharpe2": div(F.sum("r"), F.stddev_samp("r")), "returns": F.sum("r"), "std": F.stddev_samp("r"), "vol": root}
    return r.groupBy("symbol", "i0").agg(*[F.round(v, 6).alias(k) for k, v in out.items()])


@query("w25_feature_set", EV + _set_sql("b.close", True))
def w25(t):
    return _set(path(falling(t), t.bars, "close", 12), True)


_PE = f"with {PAIR}, bars1 as (select symbol, bar_id, ln(y) - ln(x) as spread, ln(y) as ly, ln(x) as lx from pair), ev as (select symbol, bar_id as i0 from bars1 where bar_id % 3 = 0)"


def _spread(t):
    b = t.pair.select("symbol", "bar_id", (F.ln("y") - F.ln("x")).alias("spread"), F.ln("y").alias("ly"), F.ln("x").alias("lx"))
    return b.where("bar_id % 3 = 0").select("symbol", F.col("bar_id").alias("i0")), b


@query("w26_pair_spread_set", _PE + _set_sql("b.spread", False).replace("join bars b", "join bars1 b"))
def w26(t):
    e, b = _spread(t)
    return _set(path(e, b, "spread", 12), False)


@query("w26_pair_regression_set", _PE + """, g as (select e.symbol, e.i0, count(*) as n, regr_slope(ly, lx) as slope, regr_intercept(ly, lx) as intercept, regr_syy(ly, lx) as syy, regr_sxy(ly, lx) as sxy from ev e join bars1 b on b.symbol = e.symbol and b.bar_id between e.i0 - 11 and e.i0 group by e.symbol, e.i0)
select symbol, i0, round(slope, 6) as slope, round(intercept, 6) as intercept, round(sqrt(greatest(syy - slope * sxy, 0) / (n - 1)), 6) as resid, round(slope / nullif(sqrt(greatest(syy - slope * sxy, 0) / (n - 1)), 0), 4) as norm from g where n = 12""")  # fmt: skip
def w26b(t):
    e, b = _spread(t)
    both = path(e, b, "ly", 12).withColumnRenamed("value", "y").join(path(e, b, "lx", 12).withColumnRenamed("value", "x"), ["symbol", "i0", "step"])
    f = ols("y", "x")
    g = both.groupBy("symbol", "i0").agg(F.count("y").alias("n"), *[f[k].alias(k) for k in ("slope", "intercept", "resid")]).where("n = 12")
    return g.select("symbol", "i0", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "resid")], F.round(div(F.col("slope"), F.col("resid")), 4).alias("norm"))


@query("w27_latest_features", S.steps(BARS, "bars", [{"lc": "ln(close)", "fin": "max(bar_id) over (partition by symbol)"}, {"z": S.z("lc", 20), "prev": "lag(close, 5) over o"}], "symbol, bar_id, round(z, 6) as blgr, round(ln(close / prev), 6) as roc", "where bar_id = fin"))
def w27(t):
    """One row for each symbol from the tail of its series: what an online model is given."""
    f = t.bars.select("symbol", "bar_id", F.round(bollinger("close", 20), 6).alias("blgr"), F.round(F.ln(F.col("close") / lag("close", 5)), 6).alias("roc"))
    last = f.groupBy("symbol").agg(F.max_by(F.struct("bar_id", "blgr", "roc"), "bar_id").alias("f"))
    return last.select("symbol", "f.*")


@query("w28_premium", S.steps(BARS + ", q as (select 'p' as symbol, a.time, (a.close / b.close) / (c.close / d.close) - 1 as pr, a.dollar / 1000 as turn, row_number() over (order by a.time) - 1 as bar_id from bars a join bars b on b.time = a.time and b.symbol = 'view' join bars c on c.time = a.time and c.symbol = 'purchase' join bars d on d.time = a.time and d.symbol = 'signup' where a.symbol = 'click')", "q", [{"back": S.roll("avg", "pr", 6), "ahead": "case when count(pr) over r_1f_6f = 6 then avg(pr) over r_1f_6f end", "turnover": S.roll("sum", "turn", 6)}], "bar_id, round(pr, 6) as premium, round(back, 6) as back, round(ahead, 6) as ahead, round(turnover, 2) as turnover"))
def w28(t):
    from strandline.functions.windows import between, roll

    side = lambda s, *c: t.bars.where(F.col("symbol") == s).select("time", *c)
    q = side("click", F.col("close").alias("a"), (F.col("dollar") / 1000).alias("turn"))
    for s, c in (("view", "b"), ("purchase", "c"), ("signup", "d")):
        q = q.join(side(s, F.col("close").alias(c)), "time")
    q = q.select(F.lit("p").alias("symbol"), "time", ((F.col("a") / F.col("b")) / (F.col("c") / F.col("d")) - 1).alias("pr"), "turn").withColumn("bar_id", F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1)
    ahead = gate(F.avg("pr").over(between(1, 6)), "pr", 6, between(1, 6))
    return q.select("bar_id", F.round("pr", 6).alias("premium"), F.round(sma("pr", 6), 6).alias("back"), F.round(ahead, 6).alias("ahead"), F.round(roll(F.sum, "turn", 6), 2).alias("turnover"))


@query("p9_depth_snapshot", f"with {BARS}, e as (select user_id, 'view' as symbol, min(ts) as time from events where event_type = 'view' group by user_id), d as (select symbol, date_trunc('hour', time) as time, list(qty order by qty, id) as q from ticks group by all), j as (select e.user_id, d.time, d.q from e asof join d on d.symbol = e.symbol and e.time > d.time) select user_id, time, q[1] as least, q[len(q)] as most, round((q[len(q)] - q[1]) / (q[len(q)] + q[1])::double, 6) as net from j")
def p9(t):
    """The last snapshot of depth strictly before an event; its rows by place."""
    e = t.read("events").where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("time")).withColumn("symbol", F.lit("view"))
    d = t.ticks.groupBy("symbol", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time")).agg(F.min("qty").alias("least"), F.max("qty").alias("most"))
    j = as_of(e, d, strict=True).where("time_r is not null")
    return j.select("user_id", F.col("time_r").alias("time"), F.col("least_r").alias("least"), F.col("most_r").alias("most"), F.round((F.col("most_r") - F.col("least_r")) / (F.col("most_r") + F.col("least_r")), 6).alias("net"))


@query("p9_depth_rows", f"with {TICKS}, e as (select user_id, event_type as symbol, min(ts) as time from events group by user_id, event_type) select e.user_id, e.symbol, e.time, (row_number() over (partition by e.user_id, e.symbol order by d.time desc, d.id desc))::int as place, d.time as row_time, d.id, d.price, d.qty from e join ticks d on d.symbol = e.symbol and d.time < e.time qualify row_number() over (partition by e.user_id, e.symbol order by d.time desc, d.id desc) <= 10")
def p9_rows(t):
    """The last ten rows before the first event of each user and kind, by place."""
    e = t.read("events").groupBy("user_id", F.col("event_type").alias("symbol")).agg(F.min("ts").alias("time"))
    return last_rows(e, t.ticks, 10).select("user_id", "symbol", "time", "place", "row_time", "id", "price", "qty")


@query("p10_paths_regression", EV + ", p as (select e.symbol, e.i0, b.close as y, b.high as x from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 - 9 and e.i0) select symbol, i0, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 4) as intercept from p group by symbol, i0")
def p10(t):
    both = path(falling(t), t.bars, "close", 10).withColumnRenamed("value", "y").join(path(falling(t), t.bars, "high", 10).withColumnRenamed("value", "x"), ["symbol", "i0", "step"])
    f = ols("y", "x")
    return both.groupBy("symbol", "i0").agg(F.round(f["slope"], 6).alias("slope"), F.round(f["intercept"], 4).alias("intercept"))


@query("p12_common_design", EV + ", p as (select e.symbol, e.i0, b.bar_id - e.i0 as step, b.close as y from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 and e.i0 + 9), g as (select symbol, i0, count(*) as n, regr_slope(y, step) as b, regr_sxx(y, step) as sxx, regr_syy(y, step) as syy, regr_sxy(y, step) as sxy from p group by symbol, i0) select symbol, i0, round(b, 6) as slope, round(b / nullif(sqrt(greatest(syy - b * sxy, 0) / (n - 2) / sxx), 0), 4) as t from g where n = 10")
def p12(t):
    f = ols("value", "step")
    g = path(falling(t), t.bars, "close", 10, forward=True).groupBy("symbol", "i0").agg(F.count("value").alias("n"), f["slope"].alias("slope"), f["t"].alias("t"))
    return g.where("n = 10").select("symbol", "i0", F.round("slope", 6).alias("slope"), F.round("t", 4).alias("t"))


@query("p17_premium_grid", f"with {BARS} select q.time, q.symbol as quote, b.symbol as base, round(q.close / b.close - 1, 6) as premium from bars q join bars b on b.time = q.time where q.symbol in ('click', 'view', 'error') and b.symbol in ('purchase', 'signup')")
def p17(t):
    q = t.bars.where(F.col("symbol").isin("click", "view", "error")).select("time", F.col("symbol").alias("quote"), "close")
    b = t.bars.where(F.col("symbol").isin("purchase", "signup")).select("time", F.col("symbol").alias("base"), F.col("close").alias("c"))
    return q.join(b, "time").select("time", "quote", "base", F.round(F.col("close") / F.col("c") - 1, 6).alias("premium"))


_RET = ", r as (select *, ln(close / lag(close) over (partition by symbol order by bar_id)) as ret from bars)"


def _ret(t):
    return t.bars.select("symbol", "bar_id", F.ln(F.col("close") / lag("close")).alias("ret"))


@query("n2_quantile_encoding", EV + _RET + ", q as (select e.symbol, e.i0, quantile_cont(r.ret, [0.25, 0.5, 0.75]) as edges from ev e join r on r.symbol = e.symbol and r.bar_id <= e.i0 group by e.symbol, e.i0) select q.symbol, q.i0, string_agg(len(list_filter(edges, lambda x: x <= r.ret))::varchar, '' order by r.bar_id) as msg from q join r on r.symbol = q.symbol and r.bar_id between q.i0 - 11 and q.i0 where r.ret is not null group by q.symbol, q.i0")
def n2(t):
    return E.quantile_messages(falling(t), _ret(t), "ret", 12, 4)


@query("n3_deviation_encoding", EV + _RET + ", q as (select e.symbol, e.i0, min(r.ret) as lo, max(r.ret) as hi, floor((max(r.ret) - min(r.ret)) / stddev_samp(r.ret)) as nb from ev e join r on r.symbol = e.symbol and r.bar_id <= e.i0 group by e.symbol, e.i0) select q.symbol, q.i0, string_agg(least(nb - 1, floor((r.ret - lo) / (hi - lo) * nb))::bigint::varchar, '' order by r.bar_id) as msg from q join r on r.symbol = q.symbol and r.bar_id between q.i0 - 11 and q.i0 where r.ret is not null and nb > 0 group by q.symbol, q.i0")
def n3(t):
    return E.deviation_messages(falling(t), _ret(t), "ret", 12)


@query("n5_match_entropy")
def n5(t):
    return E.quantile_messages(falling(t), _ret(t), "ret", 20, 3).select("symbol", "i0", "msg", F.round(E.match_entropy_of()("msg"), 6).alias("value"))


@query("n5_redundancy")
def n5_redundancy(t):
    m = E.quantile_messages(falling(t), _ret(t), "ret", 20, 3).withColumn("h", E.match_entropy_of()("msg"))
    return m.select("symbol", "i0", "msg", F.round(E.redundancy(F.col("h"), F.col("msg")), 6).alias("value"))


@query("e9_two_factor")
def e9(t):
    return E.two_factor(falling(t).select("symbol", "i0", "p0", "vol"), 6, 2.0).select("symbol", "i0")


_KELLY = "case when max(x) <= 0 then -1 when min(x) >= 0 then 1 else avg((x > 0)::int) - (1 - avg((x > 0)::int)) * -avg(case when x < 0 then x end) / avg(case when x > 0 then x end) end"
_ORDERED = f"with {TRADES_SQL}, n as (select symbol, i0, lret, lret as x, row_number() over (partition by symbol order by i0) - 1 as i, count(*) over (partition by symbol) as n from trades)"


def _kelly(x):
    win = F.avg(F.when(F.col(x) > 0, 1.0).otherwise(0.0))
    gain, loss = F.avg(F.when(F.col(x) > 0, F.col(x))), -F.avg(F.when(F.col(x) < 0, F.col(x)))
    return F.when(gain.isNull(), -1.0).when(loss.isNull(), 1.0).otherwise(win - div((1 - win) * loss, gain))


def _nth(t):
    by = Window.partitionBy("symbol").orderBy("i0")
    return trades_of(t).select("symbol", "i0", "lret", (F.row_number().over(by) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"))


@query("m7_kelly_blocks", _ORDERED + f" select symbol, i // 4 as block, round({_KELLY}, 6) as kelly from n where i // 4 < n // 4 group by symbol, block")
def m7(t):
    return _nth(t).withColumn("block", F.expr("i div 4")).where("block < n div 4").groupBy("symbol", "block").agg(F.round(_kelly("lret"), 6).alias("kelly"))


@query("m7_kelly_chunks", _ORDERED + f" select symbol, i // (n // 3) as chunk, round({_KELLY}, 6) as kelly from n where n >= 3 and i // (n // 3) < 3 group by symbol, chunk")
def m7b(t):
    return _nth(t).where("n >= 3").withColumn("chunk", F.expr("i div (n div 3)")).where("chunk < 3").groupBy("symbol", "chunk").agg(F.round(_kelly("lret"), 6).alias("kelly"))


@query("m7_kelly_rolling", _ORDERED + ", r as (select symbol, i, count(*) over w as c, avg((x > 0)::int) over w as win, avg(case when x > 0 then x end) over w as gain, -avg(case when x <= 0 then x end) over w as loss from n window w as (partition by symbol order by i rows between 4 preceding and current row)) select symbol, i, round(case when gain is null then -1 when loss is null then 1 else win - (1 - win) * loss / gain end, 6) as kelly from r where c = 5")
def m7c(t):
    w5 = Window.partitionBy("symbol").orderBy("i").rowsBetween(-4, 0)
    n = _nth(t).select("symbol", "i", F.count(F.lit(1)).over(w5).alias("c"), F.avg(F.when(F.col("lret") > 0, 1.0).otherwise(0.0)).over(w5).alias("win"), F.avg(F.when(F.col("lret") > 0, F.col("lret"))).over(w5).alias("gain"), (-F.avg(F.when(F.col("lret") <= 0, F.col("lret"))).over(w5)).alias("loss"))
    k = F.when(F.col("gain").isNull(), -1.0).when(F.col("loss").isNull(), 1.0).otherwise(F.col("win") - div((1 - F.col("win")) * F.col("loss"), F.col("gain")))
    return n.where("c = 5").select("symbol", "i", F.round(k, 6).alias("kelly"))


@query("m4_calmar", f"with {TRADES_SQL}, c as (select symbol, i0, exp(sum(lret) over (partition by symbol order by i0)) as v from trades), d as (select symbol, v / max(v) over (partition by symbol order by i0) - 1 as dd from c), m as (select symbol, abs(min(dd)) as mdd from d group by symbol) select symbol, round((exp(sum(lret)) - 1) * 365 / 30 / nullif(mdd, 0), 6) as calmar from trades join m using (symbol) group by symbol, mdd")
def m4c(t):
    by = Window.partitionBy("symbol").orderBy("i0").rowsBetween(Window.unboundedPreceding, 0)
    c = trades_of(t).withColumn("v", F.exp(F.sum("lret").over(by)))
    g = c.withColumn("dd", F.col("v") / F.max("v").over(by) - 1).groupBy("symbol").agg(F.abs(F.min("dd")).alias("mdd"), F.sum("lret").alias("r"))
    return g.select("symbol", F.round(div((F.exp("r") - 1) * 365 / 30, F.col("mdd")), 6).alias("calmar"))


@query("m9_t_test")
def m9(t):
    """One-sided p-value that the mean daily return is above zero, days without return left out."""
    d = trades_of(t).groupBy("symbol", F.to_date("t1").alias("day")).agg(F.sum("lret").alias("r")).where("r <> 0")
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), M.zscore("r").alias("t")).where("n > 1")
    return g.select("symbol", "n", F.round("t", 6).alias("t"), F.round(M.student_tail(F.col("t"), F.col("n") - 1), 6).alias("p"))


@query("m10_max_group", _ORDERED + ", g as (select symbol, i // ceil(n / 3.0::double)::bigint as part, sum(lret) as s from n group by symbol, part) select symbol, round(max(s) / nullif(sum(s), 0), 4) as share from g group by symbol")
def m10b(t):
    g = _nth(t).groupBy("symbol", F.expr("i div cast(ceil(n / 3.0D) as bigint)").alias("part")).agg(F.sum("lret").alias("s"))
    return g.groupBy("symbol").agg(F.round(div(F.max("s"), F.sum("s")), 4).alias("share"))


@query("m15_report_table", f"with {TRADES_SQL} select symbol, count(*) as trades, round(sum(lret), 6) as total, round(avg(lret), 6) as mean, round(median(lret), 6) as median, round(max(lret), 6) as best, round(min(lret), 6) as worst, round(avg((lret > 0)::int), 6) as win, round(median(epoch_us(t1) - epoch_us(t0)) / 3.6e9, 6) as hours from trades group by symbol")
def m15(t):
    hours = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 3.6e9
    f = {"total": F.sum("lret"), "mean": F.avg("lret"), "median": F.median("lret"), "best": F.max("lret"), "worst": F.min("lret"), "win": F.avg(F.when(F.col("lret") > 0, 1.0).otherwise(0.0)), "hours": F.median(hours)}
    return trades_of(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), *[F.round(v, 6).alias(k) for k, v in f.items()])


_U = "(('0x' || substr(md5('boot:' || symbol || ':' || it || ':' || blk), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double"


@query("b1_block_bootstrap", f"with {BARS}{_RET}, s as (select symbol, bar_id - 1 as k, ret, count(*) over (partition by symbol) - 5 as m from r where ret is not null), w as (select symbol, k, power(0.5::double, (k + 1) / m::double) as w from s where k < m), c as (select symbol, k, sum(w) over (partition by symbol order by k) / sum(w) over (partition by symbol) as hi from w), d as (select symbol, it, blk, {_U} as u from (select distinct symbol from s), range(20) a(it), range(3) b(blk)), p as (select d.symbol, it, blk, min(k) as k from d join c on c.symbol = d.symbol and c.hi > d.u group by d.symbol, it, blk) select p.symbol, it::int as it, round(sum(s.ret), 6) as total, count(*) as n from p, range(5) o(off) join s on s.symbol = p.symbol and s.k = p.k + off group by p.symbol, it")
def b1(t):
    s = _ret(t).where("ret is not null").select("symbol", (F.col("bar_id") - 1).alias("k"), "ret")
    i = block_indices(recency_weights(s, 5, 0.5), 5, 3, 20)
    return i.join(s, ["symbol", "k"]).groupBy("symbol", "it").agg(F.round(F.sum("ret"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query("b3_stair_weights", f"with {BARS}, s as (select symbol, bar_id as k, time, max(time) over (partition by symbol) as fin, count(*) over (partition by symbol) - 4 as m from bars), g as (select *, case when time >= fin - interval 5 day then 3 when time >= fin - interval 10 day then 2 else 1 end as part from s where k < m), c as (select *, count(*) over (partition by symbol, part) as n, case part when 1 then 0.1::double when 2 then 0.3::double else 0.6::double end as p from g) select symbol, k, round(p / n / sum(p / n) over (partition by symbol), 9) as weight from c")
def b3(t):
    s = t.bars.select("symbol", F.col("bar_id").alias("k"), "time")
    return stair_weights(s, 5, "interval 5 days", (0.1, 0.3, 0.6)).select("symbol", "k", F.round("weight", 9).alias("weight"))


@query("b6_average_uniqueness", EV + ", l as (select symbol, max(bar_id) as fin from bars group by symbol), e as (select symbol, i0, least(i1, fin) as i1 from ev join l using (symbol)), c as (select b.symbol, b.bar_id, count(*) as held from bars b join e on e.symbol = b.symbol and b.bar_id between e.i0 and e.i1 group by b.symbol, b.bar_id), u as (select e.symbol, e.i0, avg(1.0::double / held) as u from e join c on c.symbol = e.symbol and c.bar_id between e.i0 and e.i1 group by e.symbol, e.i0) select symbol, round(avg(u), 6) as uniqueness from u group by symbol")
def b6(t):
    from strandline.operators.weights import uniqueness

    return uniqueness(falling(t), t.bars).groupBy("symbol").agg(F.round(F.avg("weight"), 6).alias("uniqueness"))


_SCORED = S.steps(BARS, "bars", [{"lc": "ln(close)", "nx": "lead(close) over o"}, {"z": S.z("lc", 20)}], "", "").split("\nselect")[0] + ", sc as (select symbol, (nx > close)::int as y, abs(ln(nx / close)) as wt, 1 / (1 + exp(z)) as p from step1 where z is not null and nx is not null)"


def _scored(t):
    b = t.bars.select("symbol", bollinger("close", 20).alias("z"), F.lead("close").over(order()).alias("nx"), "close").where("z is not null and nx is not null")
    return b.select("symbol", (F.col("nx") > F.col("close")).cast("int").alias("y"), F.abs(F.ln(F.col("nx") / F.col("close"))).alias("wt"), (1 / (1 + F.exp("z"))).alias("p"))


@query("k3_log_loss", _SCORED + " select symbol, round(-sum(wt * ln(case when y = 1 then p else 1 - p end)) / sum(wt), 6) as log_loss, round(sum(wt * ((p >= 0.5)::int = y)::int) / sum(wt), 6) as accuracy from sc group by symbol")
def k3(t):
    from strandline.operators.scores import accuracy, log_loss

    return _scored(t).groupBy("symbol").agg(F.round(log_loss("y", "p", "wt"), 6).alias("log_loss"), F.round(accuracy("y", "p", "wt"), 6).alias("accuracy"))


@query("k4_threshold_scores", _SCORED + ", g as (select symbol, thr, sum(y * (p >= thr)::int)::double as tp, sum((p >= thr)::int) as pp, sum(y) as ap from sc, (values (0.4::double), (0.5::double), (0.6::double)) t(thr) group by symbol, thr), m as (select symbol, thr, case when pp > 0 then tp / pp else 0 end as precision, case when ap > 0 then tp / ap else 0 end as recall from g) select symbol, thr, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1, round((precision * 10 + recall) / 11, 6) as f2 from m")
def k4(t):
    from strandline.operators.scores import by_threshold

    return by_threshold(_scored(t), [0.4, 0.5, 0.6])


@query("k11_report", _SCORED + ", l as (select symbol, label, sum((y = label and (p >= 0.5)::int = label)::int)::double as tp, sum(((p >= 0.5)::int = label)::int) as pp, sum((y = label)::int) as support from sc, (values (0), (1)) t(label) group by symbol, label) select symbol, label::int as label, round(case when pp > 0 then tp / pp else 0 end, 6) as precision, round(case when support > 0 then tp / support else 0 end, 6) as recall, round(case when tp > 0 then 2 * tp / (pp + support) else 0 end, 6) as f1, support::bigint as support from l")
def k11(t):
    from strandline.operators.scores import report

    return report(_scored(t))


@query("k10_bet_sizes", _SCORED + " select symbol, count(*) as n, round(sum(greatest(2 * p - 1, 0)), 6) as size, round(sum(ln(1 + greatest(2 * p - 1, 0) * (exp(case when y = 1 then wt else -wt end) - 1))), 6) as lret from sc group by symbol")
def k10(t):
    size = F.greatest(2 * F.col("p") - 1, F.lit(0.0))
    r = F.log1p(size * F.expm1(F.when(F.col("y") == 1, F.col("wt")).otherwise(-F.col("wt"))))
    return _scored(t).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(size), 6).alias("size"), F.round(F.sum(r), 6).alias("lret"))
