"""Queries of cleaning, labels over intervals, measures, folds and threshold grids."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import metrics as M
from strandline.functions.windows import between, order
from strandline.operators import cleaning as C
from strandline.operators import folds as K
from strandline.operators.paths import as_of, in_reach
from strandline.sources.tables import BARS, DAYS, PAIR, TICKS

from . import sqltext as S
from .events import _PATH, EV, falling
from .flagship import TRADES_SQL, trades_of
from .registry import query


@query("c3_common_span", f"with {BARS}, e as (select min(time) as a, max(time) as b from bars group by symbol), s as (select max(a) as a, min(b) as b from e) select symbol, bar_id from bars, s where time between s.a and s.b")
def c3(t):
    return C.common_span(t.bars).select("symbol", "bar_id")


@query("c4_index_intersection", f"with {PAIR} select time, y, x from pair")
def c4(t):
    return t.pair.select("time", "y", "x")


@query("c5_aligned_ratio", f"with {BARS} select coalesce(a.time, b.time) as time, round(a.close / b.close, 9) as ratio from (select * from bars where symbol = 'click') a full join (select * from bars where symbol = 'view') b on a.time = b.time where a.close is not null and b.close is not null")
def c5(t):
    a, b = (t.bars.where(F.col("symbol") == s).select("time", F.col("close").alias(c)) for s, c in (("click", "a"), ("view", "b")))
    return a.join(b, "time").select("time", F.round(F.col("a") / F.col("b"), 9).alias("ratio"))


@query("c7_distinct_rows", f"with {TICKS} select symbol, qty, min(time) as time from ticks group by symbol, qty")
def c7(t):
    return t.ticks.groupBy("symbol", "qty").agg(F.min("time").alias("time"))


@query("c8_first_of_day", f"with {BARS} select symbol, time, close from bars qualify row_number() over (partition by symbol, time::date order by time) = 1")
def c8(t):
    return C.first_of_day(t.bars).select("symbol", "time", "close")


@query("c10_finite", f"with {BARS}, r as (select symbol, bar_id, ln(close) / nullif(ln(open) - ln(close), 0) as r from bars) select symbol, bar_id, round(r, 6) as value from r where r is not null and not isnan(r) and not isinf(r)")
def c10(t):
    r = F.ln("close") / F.nullif(F.ln("open") - F.ln("close"), F.lit(0.0))
    return t.bars.select("symbol", "bar_id", F.round(C.finite(r), 6).alias("value")).na.drop(subset=["value"])


@query("c12_separate_times", "with d as (select *, date_trunc('day', ts) as day from events) select event_type as symbol, event_id as id, day + to_microseconds(row_number() over (partition by event_type, day order by event_id) - 1) as time from d")
def c12(t):
    d = t.read("events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"))
    return C.separate_times(d, "id")


@query("c13_every_nth", f"with {BARS} select symbol, bar_id, close from bars where bar_id >= 20 and (bar_id - 20) % 5 = 0")
def c13(t):
    return t.bars.where("bar_id >= 20 and (bar_id - 20) % 5 = 0").select("symbol", "bar_id", "close")


@query("c14_control_sample", f"with {BARS}, n as (select symbol, count(*) as n from bars group by symbol), k as (select distinct symbol, floor(i * (n - 1) / 24)::bigint as bar_id from n, range(25) r(i)) select symbol, bar_id from bars semi join k using (symbol, bar_id)")
def c14(t):
    return C.evenly_spaced(t.bars, 25).select("symbol", "bar_id")


@query("c16_universe", f"with {TICKS}, a as (select distinct symbol from ticks where price > 100) select symbol, count(*) as n from ticks semi join a using (symbol) group by symbol")
def c16(t):
    return t.ticks.join(t.ticks.where("price > 100").select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("c18_session", "select event_id, isodow(l) < 6 and strftime(l, '%H:%M:%S') between '09:30:00' and '16:00:00' as session from (select event_id, (ts at time zone 'UTC') at time zone 'America/New_York' as l from events)")
def c18(t):
    return t.read("events").select("event_id", C.in_session("ts").alias("session"))


@query("c20_round_down", f"with {BARS}, y as (select symbol, bar_id, close * (1 + 0.005::double) as y from bars) select symbol, bar_id, round(y - fmod(y, 5), 6) as value from y")
def c20(t):
    return t.bars.select("symbol", "bar_id", F.round(C.round_down("close", 5.0), 6).alias("value"))


@query("c21_significant_digits", f"with {BARS}, s as (select symbol, bar_id, close, power(10.0::double, 1 - floor(log10(abs(close)))) as s from bars) select symbol, bar_id, ceil(close * s) / s as up, floor(close * s) / s as down, round_even(close * s, 0) / s as near from s")
def c21(t):
    return t.bars.select("symbol", "bar_id", *[C.significant("close", 2, how).alias(n) for how, n in (("ceil", "up"), ("floor", "down"), ("round", "near"))])


@query("c25_liquidation", f"with {BARS} select symbol, bar_id, round(close * (1 - 0.1::double) * 1.005::double, 6) as long_price, round(close * (1 + 0.1::double) * 0.995::double, 6) as short_price from bars")
def c25(t):
    return t.bars.select("symbol", "bar_id", F.round(C.liquidation_price("close", 10), 6).alias("long_price"), F.round(C.liquidation_price("close", 10, False), 6).alias("short_price"))


@query("c27_anti_membership", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def c27(t):
    return t.read("part").join(t.read("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("a7_daily_sum", f"with {TRADES_SQL} select symbol, date_trunc('day', t1)::timestamp as day, round(sum(lret), 6) as lret from trades group by all")
def a7(t):
    return trades_of(t).groupBy("symbol", F.to_date("t1").cast("timestamp_ntz").alias("day")).agg(F.round(F.sum("lret"), 6).alias("lret"))


@query("a8_events_per_day", f"with {TRADES_SQL} select symbol, round(count(*) / (datediff('day', min(t0)::date, max(t0)::date) + 1), 9) as per_day from trades group by symbol")
def a8(t):
    days = F.date_diff(F.to_date(F.max("t0")), F.to_date(F.min("t0"))) + 1
    return trades_of(t).groupBy("symbol").agg(F.round(F.count(F.lit(1)) / days, 9).alias("per_day"))


@query("p2_strictly_before", f"with {BARS}, l as (select symbol, bar_id, time - interval 6 hour as at from bars) select l.symbol, l.bar_id, b.close as past from l asof left join bars b on b.symbol = l.symbol and l.at > b.time")
def p2(t):
    left = t.bars.select("symbol", "bar_id", (F.col("time") - F.expr("interval 6 hours")).alias("time"))
    return as_of(left, t.bars.select("symbol", "time", "close"), strict=True).select("symbol", "bar_id", F.col("close_r").alias("past"))


@query("p4_vertical_barrier", f"with {BARS}, l as (select symbol, bar_id, time + interval 7 hour as at from bars) select l.symbol, l.bar_id, b.bar_id as i1 from l asof join bars b on b.symbol = l.symbol and l.at <= b.time")
def p4(t):
    left = t.bars.select("symbol", F.col("bar_id").alias("at"), (F.col("time") + F.expr("interval 7 hours")).alias("time"))
    return as_of(left, t.bars.select("symbol", "time", "bar_id"), forward=True).where("bar_id_r is not null").select("symbol", F.col("at").alias("bar_id"), F.col("bar_id_r").alias("i1"))


@query("p5_horizon_clamped", EV + " select e.symbol, e.i0, least(e.i1, max(b.bar_id)) as i1 from ev e join bars b on b.symbol = e.symbol group by e.symbol, e.i0, e.i1")
def p5(t):
    last = t.bars.groupBy("symbol").agg(F.max("bar_id").alias("last"))
    return falling(t).join(last, "symbol").select("symbol", "i0", F.least("i1", "last").alias("i1"))


@query("p7_interval_apply", EV + _PATH.format(a="", b="+ 10") + " select symbol, i0, count(*) as n, max(high) as top, min(low) as bottom, round(avg(close), 6) as mean from p group by symbol, i0")
def p7(t):
    p = in_reach(falling(t), t.bars.select("symbol", "bar_id", "close", "high", "low"), 0, 10)
    return p.groupBy("symbol", "i0").agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("top"), F.min("low").alias("bottom"), F.round(F.avg("close"), 6).alias("mean"))


_THR = (0.5, 1.0, 1.5, 2.0)


@query("p16_threshold_grid", S.steps(BARS, "bars", [{"lc": "ln(close)"}, {"z": S.z("lc", 20)}, {"zp": "lag(z) over o"}], "symbol, thr::double as thr, count(*) as n", f", (values {', '.join(f'({v})' for v in _THR)}) g(thr) where z >= thr and zp < thr group by symbol, thr"))
def p16(t):
    from strandline.functions.windows import bollinger, lag

    z = t.bars.withColumn("z", bollinger("close", 20)).withColumn("zp", lag("z")).select("symbol", "z", "zp", F.explode(F.array(*map(F.lit, _THR))).alias("thr"))
    return z.where("z >= thr and zp < thr").groupBy("symbol", "thr").agg(F.count(F.lit(1)).alias("n"))


@query("e6_find_threshold", S.steps(BARS, "bars", [{"lc": "ln(close)"}, {"z": S.z("lc", 20)}, {"zp": "lag(z) over o"}], "symbol, arg_min(thr, {'a': abs(n - 10), 'b': thr})::double as thr", "") .replace("from step2", f"from (select symbol, thr, count(case when z >= thr and zp < thr then 1 end) as n from step2, (values {', '.join(f'({v})' for v in _THR)}) g(thr) group by symbol, thr) group by symbol"))
def e6(t):
    """The threshold of the grid whose number of crossings is nearest to ten; the smallest of equals."""
    from strandline.functions.windows import bollinger, lag

    z = t.bars.withColumn("z", bollinger("close", 20)).withColumn("zp", lag("z")).select("symbol", "z", "zp", F.explode(F.array(*map(F.lit, _THR))).alias("thr"))
    n = z.groupBy("symbol", "thr").agg(F.count(F.when(F.col("z").isNotNull() & (F.col("z") >= F.col("thr")) & (F.col("zp") < F.col("thr")), 1)).alias("n"))
    return n.groupBy("symbol").agg(F.min_by("thr", F.struct(F.abs(F.col("n") - 10).alias("a"), "thr")).alias("thr"))


_PREM = [{"pr": "y / x - 1"}, {"m": "case when count(pr) over w6 = 6 then avg(pr) over w6 end", "f9": "case when count(pr) over r_4f_9f = 6 then avg(pr) over r_4f_9f end", "f15": "case when count(pr) over r_10f_15f = 6 then avg(pr) over r_10f_15f end"}]


@query("e10_premium_trigger", S.steps(PAIR, "pair", _PREM, "time, round(m, 6) as m, round(f9, 6) as f9, round(f15, 6) as f15", "where abs(m) >= 0.03 qualify row_number() over (partition by time::date order by time) = 1"))
def e10(t):
    from strandline.functions.windows import gate

    mean = lambda a, b: gate(F.avg("pr").over(between(a, b)), "pr", 6, between(a, b))
    p = t.pair.withColumn("pr", F.col("y") / F.col("x") - 1).select("symbol", "time", mean(-5, 0).alias("m"), mean(4, 9).alias("f9"), mean(10, 15).alias("f15"))
    return C.first_of_day(p.where(F.abs("m") >= 0.03)).select("time", *[F.round(c, 6).alias(c) for c in ("m", "f9", "f15")])


@query("l12_path_sharpe", EV + _PATH.format(a="", b="+ 10") + """, q as (select *, ln(close / lag(close) over (partition by symbol, i0 order by bar_id)) as r from p)
select symbol, i0, round(sum(r) / nullif(sqrt(sum(r * r)), 0), 6) as sharpe, round(avg(case when step > 0 then (close - p0) / step end), 6) as slope from q group by symbol, i0""")  # fmt: skip
def l12(t):
    p = in_reach(falling(t), t.bars.select("symbol", "bar_id", "close"), 0, 10).withColumn("step", F.col("bar_id") - F.col("i0"))
    r = p.withColumn("r", F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("symbol", "i0").orderBy("bar_id"))))
    return r.groupBy("symbol", "i0").agg(F.round(F.try_divide(F.sum("r"), F.sqrt(F.sum(F.col("r") * F.col("r")))), 6).alias("sharpe"), F.round(F.avg(F.when(F.col("step") > 0, (F.col("close") - F.col("p0")) / F.col("step"))), 6).alias("slope"))


_HOLD = (1, 6, 24)


@query("l16_wide_returns", EV + " select e.symbol, e.i0, " + ", ".join(f"round(max(case when b.bar_id = e.i0 + {h} then b.close end) / e.p0 - 1, 9) as ret_{h}" for h in _HOLD) + f", round(min(case when b.bar_id <= e.i0 + 6 then b.low end) / e.p0 - 1, 9) as low_6 from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 and e.i0 + {max(_HOLD)} group by e.symbol, e.i0, e.p0")
def l16(t):
    p = in_reach(falling(t), t.bars.select("symbol", "bar_id", "close", "low"), 0, max(_HOLD))
    after = F.col("bar_id") - F.col("i0")
    g = p.groupBy("symbol", "i0", "p0").agg(*[F.max(F.when(after == h, F.col("close"))).alias(f"c{h}") for h in _HOLD], F.min(F.when(after <= 6, F.col("low"))).alias("lo"))
    return g.select("symbol", "i0", *[F.round(F.col(f"c{h}") / F.col("p0") - 1, 9).alias(f"ret_{h}") for h in _HOLD], F.round(F.col("lo") / F.col("p0") - 1, 9).alias("low_6"))


@query("m2_sharpe", f"with {TRADES_SQL}, d as (select symbol, sum(lret) as r from trades group by symbol, t1::date) select symbol, round(avg(r) / nullif(stddev_samp(r) / sqrt(count(r) * 365.0::double / 30), 0), 6) as sharpe, round(sum(r) / nullif(sqrt(sum(r * r)), 0) / sqrt(count(r) * 365.0::double / 30), 6) as zero_mean from d group by symbol")
def m2(t):
    d = trades_of(t).groupBy("symbol", F.to_date("t1").alias("day")).agg(F.sum("lret").alias("r"))
    return d.groupBy("symbol").agg(F.round(M.sharpe("r", F.lit(30)), 6).alias("sharpe"), F.round(M.sharpe_zero("r", F.lit(30)), 6).alias("zero_mean"))


def _by_start(t, *cols) -> DataFrame:
    return trades_of(t).select("symbol", "i0", "lret", *cols)


@query("m5_concentration", f"with {TRADES_SQL}, n as (select symbol, lret, ntile(4) over (partition by symbol order by i0) as part from trades), p as (select symbol, part, sum(lret) as s from n group by symbol, part) select symbol, round(4 * sum(s * s) / nullif(sum(s) * sum(s), 0), 4) as hhi from p group by symbol")
def m5(t):
    p = _by_start(t, F.ntile(4).over(Window.partitionBy("symbol").orderBy("i0")).alias("part")).groupBy("symbol", "part").agg(F.sum("lret").alias("s"))
    return p.groupBy("symbol").agg(F.round(F.try_divide(4 * F.sum(F.col("s") * F.col("s")), F.sum("s") * F.sum("s")), 4).alias("hhi"))


_NTH = "(row_number() over (partition by symbol order by i0) - 1)"


def _nth():
    return F.row_number().over(Window.partitionBy("symbol").orderBy("i0")) - 1


@query("m6_subperiod_zscore", f"with {TRADES_SQL}, n as (select symbol, lret, {_NTH} as i, count(*) over (partition by symbol) as n from trades), p as (select symbol, least(i // (n // 3), 2) as part, lret from n where n >= 3 and lret <> 0) select symbol, part, round(avg(lret) / nullif(stddev_samp(lret), 0) * sqrt(count(*)), 5) as zscore from p group by symbol, part")
def m6(t):
    n = _by_start(t, _nth().alias("i"), F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n")).where("n >= 3")
    return n.withColumn("part", F.expr("least(i div (n div 3), 2)")).where("lret <> 0").groupBy("symbol", "part").agg(F.round(M.zscore("lret"), 5).alias("zscore"))


@query("m8_block_sums", f"with {TRADES_SQL}, n as (select symbol, lret, {_NTH} // 3 as block from trades) select symbol, block, round(sum(lret), 6) as lret from n group by symbol, block having count(*) = 3")
def m8(t):
    n = _by_start(t, F.expr("(row_number() over (partition by symbol order by i0) - 1) div 3").alias("block"))
    return n.groupBy("symbol", "block").agg(F.round(F.sum("lret"), 6).alias("lret"), F.count(F.lit(1)).alias("n")).where("n = 3").drop("n")


@query("m10_contribution", f"with {TRADES_SQL}, q as (select symbol, quantile_cont(lret, 0.8) as q from trades group by symbol) select symbol, round(sum(case when lret >= q then lret end), 6) as top from trades join q using (symbol) group by symbol")
def m10(t):
    tr = trades_of(t).select("symbol", "lret")
    q = tr.groupBy("symbol").agg(F.percentile("lret", F.lit(0.8)).alias("q"))
    return tr.join(q, "symbol").groupBy("symbol").agg(F.round(F.sum(F.when(F.col("lret") >= F.col("q"), F.col("lret"))), 6).alias("top"))


@query("m12_probability_bins", S.steps(BARS, "bars", [{"lc": "ln(close)"}, {"z": S.z("lc", 20), "r": "ln(lead(close) over o / close)"}], "symbol, (ceil(z * 2) / 2 - 0.5)::double as lower, count(*) as n, round(sum(r), 6) as total, round(sum(case when r > 0 then r else 0 end) / nullif(sum(abs(r)), 0), 6) as prob", "where z is not null and r is not null group by symbol, lower"))
def m12(t):
    from strandline.functions.windows import bollinger

    b = t.bars.select("symbol", bollinger("close", 20).alias("z"), F.ln(F.lead("close").over(order()) / F.col("close")).alias("r")).where("z is not null and r is not null")
    return b.groupBy("symbol", (F.ceil(F.col("z") * 2) / 2 - 0.5).alias("lower")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 6).alias("total"), F.round(F.try_divide(F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), F.sum(F.abs("r"))), 6).alias("prob"))


@query("m13_premium_profit", S.steps(PAIR, "pair", _PREM, "count(*) as n, round(avg((m - f9) * sign(m) - 0.002), 6) as mean, round(stddev_samp((m - f9) * sign(m) - 0.002) / sqrt(count(*)), 6) as error", "where m is not null and f9 is not null"))
def m13(t):
    from strandline.functions.windows import gate

    mean = lambda a, b: gate(F.avg("pr").over(between(a, b)), "pr", 6, between(a, b))
    p = t.pair.withColumn("pr", F.col("y") / F.col("x") - 1).select(mean(-5, 0).alias("m"), mean(4, 9).alias("f9")).na.drop()
    r = (F.col("m") - F.col("f9")) * F.signum("m") - 0.002
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_samp(r) / F.sqrt(F.count(F.lit(1))), 6).alias("error"))


@query("m14_default_precision", f"with {TRADES_SQL} select symbol, round(sum(case when lret > 0 then lret else 0 end) / sum(abs(lret)), 6) as precision from trades group by symbol")
def m14(t):
    return trades_of(t).groupBy("symbol").agg(F.round(F.try_divide(F.sum(F.when(F.col("lret") > 0, F.col("lret")).otherwise(0.0)), F.sum(F.abs("lret"))), 6).alias("precision"))


@query("b6_overlap_pairs", EV + " select a.symbol, a.i0 as a, b.i0 as b from ev a join ev b on a.symbol = b.symbol and a.i0 < b.i0 and b.i0 <= a.i1")
def b6(t):
    return K.overlaps(falling(t), 11)


@query("k1_time_folds", """with s as (select min(ts)::date as a, max(ts)::date as b from events), d as (select *, (b - a + 1) // 5 as days from s)
select i::bigint as fold, a::timestamp as train_start, (a + (i * (days - 1) - 4)::int)::timestamp as train_end, (a + (i * (days - 1))::int)::timestamp as test_start,
  (case when i = 4 then b else a + (i * (days - 1) + days - 1)::int end)::timestamp as test_end from d, range(1, 5) r(i)""")  # fmt: skip
def k1(t):
    days = K.spanned_folds(t.read("events"), 5, "ts", warm_up=1, gap_days=3)
    return days.select("fold", *[F.col(c).cast("timestamp_ntz").alias(c) for c in days.columns[1:]])


@query("k2_purged_folds", EV + """, e as (select symbol, i0, i1, ntile(4) over (partition by symbol order by i0) as own, row_number() over (partition by symbol order by i0) - 1 as k, count(*) over (partition by symbol) as n from ev),
b as (select symbol, own as fold, min(i0) as t0, max(i1) as t1, floor(any_value(n) * 0.05::double) as gap from e group by symbol, own), a as (select b.*, (select min(k) from e where e.symbol = b.symbol and e.i0 >= b.t1) as r from b),
j as (select e.symbol, a.fold::int as fold, e.i0, case when e.own = a.fold then 'test' when e.i1 <= a.t0 or e.k >= a.r + a.gap then 'train' end as role from e join a on a.symbol = e.symbol) select * from j where role is not null""")  # fmt: skip
def k2(t):
    return K.purged_folds(falling(t), 4, 0.05)


@query("a1_daily_bars", f"with {DAYS} select symbol, bar_id, round(high, 6) as high, round(low, 6) as low, close from days")
def days(t):
    return t.days.select("symbol", "bar_id", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"), "close")
