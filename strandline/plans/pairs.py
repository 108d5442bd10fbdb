"""Queries of every two symbols, where those of research, statistics and features have one pair: the pair is part of the key, rolling windows run by block."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.windows import between, gate, w
from strandline.operators.blocks import by_block
from strandline.operators.cleaning import first_of_day
from strandline.operators.paths import path
from strandline.sources.tables import PAIRS

from . import sqltext as S
from .features import _set, _set_sql
from .registry import query
from .research import _PREM
from .statistics import _FIT


@query("c4_all_pairs", f"with {PAIRS} select symbol, bar_id, time, y, x from pairs")
def c4(t):
    """The times that both symbols of a pair have."""
    return t.pairs.select("symbol", "bar_id", "time", "y", "x")


@query("s14_all_pairs", f"with {PAIRS} select symbol, time, round((x - y) / y, 9) as spread from pairs")
def s14(t):
    return t.pairs.select("symbol", "time", F.round((F.col("x") - F.col("y")) / F.col("y"), 9).alias("spread"))


@query("p13_all_pairs", S.steps(PAIRS, "pairs", [{"c": _FIT.format("covar_samp(y, x) over w30 / nullif(stddev_samp(y) over w30 * stddev_samp(x) over w30, 0)")}], "symbol, bar_id, round(c * 30 / 29, 6) as value"))
def p13(t):
    c = F.try_divide(F.covar_samp("y", "x").over(w(30)), F.stddev_samp("y").over(w(30)) * F.stddev_samp("x").over(w(30)))
    return by_block(t.pairs, lambda p: p.withColumn("value", F.round(gate(c, "x", 30) * 30 / 29, 6)), 29).select("symbol", "bar_id", "value")


@query("p14_all_pairs", S.steps(PAIRS, "pairs", [{"slope": _FIT.format("regr_sxy(y, x) over w30 / nullif(regr_sxx(y, x) over w30, 0)")}], "symbol, bar_id, round(slope, 6) as slope"))
def p14(t):
    slope = F.try_divide(F.regr_sxy("y", "x").over(w(30)), F.regr_sxx("y", "x").over(w(30)))
    return by_block(t.pairs, lambda p: p.withColumn("slope", F.round(gate(slope, "x", 30), 6)), 29).select("symbol", "bar_id", "slope")


def _premium(t):
    """Mean premiums of the last six bars (m), of the six from the fourth and from the tenth bar ahead on (f9, f15)."""
    mean = lambda a, b: gate(F.avg("pr").over(between(a, b)), "pr", 6, between(a, b))
    add = lambda p: p.withColumn("pr", F.col("y") / F.col("x") - 1).select("*", mean(-5, 0).alias("m"), mean(4, 9).alias("f9"), mean(10, 15).alias("f15"))
    return by_block(t.pairs, add, 5, 15)


@query("e10_all_pairs", S.steps(PAIRS, "pairs", _PREM, "symbol, time, round(m, 6) as m, round(f9, 6) as f9, round(f15, 6) as f15", "where abs(m) >= 0.03 qualify row_number() over (partition by symbol, time::date order by time) = 1"))
def e10(t):
    hit = _premium(t).select("symbol", "time", "m", "f9", "f15").where(F.abs("m") >= 0.03)
    return first_of_day(hit).select("symbol", "time", *[F.round(c, 6).alias(c) for c in ("m", "f9", "f15")])


@query("m13_all_pairs", S.steps(PAIRS, "pairs", _PREM, "symbol, count(*) as n, round(avg((m - f9) * sign(m) - 0.002), 6) as mean, round(stddev_samp((m - f9) * sign(m) - 0.002) / sqrt(count(*)), 6) as error", "where m is not null and f9 is not null group by symbol"))
def m13(t):
    p = _premium(t).where("m is not null and f9 is not null")
    r = (F.col("m") - F.col("f9")) * F.signum("m") - 0.002
    return p.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.stddev_samp(r) / F.sqrt(F.count(F.lit(1))), 6).alias("error"))


_PE = f"with {PAIRS}, bars1 as (select symbol, bar_id, ln(y) - ln(x) as spread from pairs), ev as (select symbol, bar_id as i0 from bars1 where bar_id % 3 = 0)"


@query("w26_all_pairs", _PE + _set_sql("b.spread", False).replace("join bars b", "join bars1 b"))
def w26(t):
    b = t.pairs.select("symbol", "bar_id", (F.ln("y") - F.ln("x")).alias("spread"))
    return _set(path(b.where("bar_id % 3 = 0").select("symbol", F.col("bar_id").alias("i0")), b, "spread", 12), False)
