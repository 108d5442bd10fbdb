"""Queries of unit roots and explosiveness, with the two-regressor closed form as SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandline.functions.windows import fractional_difference, fractional_weights, lag
from strandline.operators import unitroot as U
from strandline.operators.paths import path
from strandline.sources.tables import BARS

from .events import EV, falling
from .registry import query

#: t value of a in y on a and b with intercept, from sums.
_SUMS = """, s as (select {k}, count(*) as n, covar_pop(a, a) * count(*) as aa, covar_pop(b, b) * count(*) as bb, covar_pop(a, b) * count(*) as ab, covar_pop(a, y) * count(*) as ay, covar_pop(b, y) * count(*) as by_, covar_pop(y, y) * count(*) as yy from d where y is not null and a is not null and b is not null group by {k}),
f as (select *, aa * bb - ab * ab as det from s), h as (select *, (bb * ay - ab * by_) / nullif(det, 0) as b1, (aa * by_ - ab * ay) / nullif(det, 0) as b2 from f),
t as (select *, case when n > 3 then b1 / nullif(sqrt(greatest(yy - b1 * ay - b2 * by_, 0) / (n - 3) * bb / nullif(det, 0)), 0) end as t from h)"""


def _path(n: int) -> str:
    return EV + f", p as (select e.symbol, e.i0, b.bar_id - e.i0 + {n - 1} as step, ln(b.close) as v, count(*) over (partition by e.symbol, e.i0) as m from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 - {n - 1} and e.i0), w as (select *, lag(v) over o as l1, lag(v, 2) over o as l2 from p where m = {n} window o as (partition by symbol, i0 order by step))"


def _full(t, n: int, log: bool = True):
    p = path(falling(t), t.bars.withColumn("c", F.ln("close") if log else F.col("close")), "c", n)
    return p.join(p.groupBy("symbol", "i0").agg(F.count(F.lit(1)).alias("m")).where(f"m = {n}").drop("m"), ["symbol", "i0"])


@query("r4_adf", _path(20) + ", d as (select symbol, i0, v - l1 as y, l1 as a, l1 - l2 as b from w)" + _SUMS.format(k="symbol, i0") + " select symbol, i0, round(t, 4) as value from t")
def r4(t):
    return U.over_paths(_full(t, 20), lambda y: U.adf(y, "c", 1)).withColumn("value", F.round("value", 4))


@query("r5_design", _path(12) + " select symbol, i0, step - 2 as row, round(v - l1, 9) as y, round(l1, 9) as level, round(l1 - l2, 9) as change from w where l2 is not null")
def r5(t):
    """The regressors of an ADF test with one lag, as columns over the path."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "i0").orderBy("step")
    q = _full(t, 12).withColumn("l1", F.lag("value").over(w)).withColumn("l2", F.lag("value", 2).over(w)).where("l2 is not null")
    return q.select("symbol", "i0", (F.col("step") - 2).alias("row"), F.round(F.col("value") - F.col("l1"), 9).alias("y"), F.round("l1", 9).alias("level"), F.round(F.col("l1") - F.col("l2"), 9).alias("change"))


@query("r6_backward_sup_adf", _path(21) + ", d as (select symbol, i0, start, v - l1 as y, l1 as a, l1 - l2 as b from w, range(0, 11) r(start) where l2 is not null and step - 2 >= start)" + _SUMS.format(k="symbol, i0, start") + " select symbol, i0, round(max(t), 4) as value from t group by symbol, i0")
def r6(t):
    return U.over_paths(_full(t, 21), lambda y: U.backward_sup_adf(y, 10, "c", 1)).withColumn("value", F.round("value", 4))


@query("r7_martingale_poly2", _path(20) + ", d as (select symbol, i0, start, v as y, (step * step)::double as a, step::double as b from w, range(0, 11) r(start) where step >= start)" + _SUMS.format(k="symbol, i0, start") + " select symbol, i0, round(max(abs(t)), 4) as value from t group by symbol, i0")
def r7(t):
    return U.over_paths(_full(t, 20, False), lambda y: U.martingale_test(y, "poly2", 10)).withColumn("value", F.round("value", 4))


@query("r8_recursive_cusum")
def r8(t):
    return U.over_paths(_full(t, 20), lambda y: U.recursive_cusum(y, 1)).join(falling(t).select("symbol", "i0", "vol"), ["symbol", "i0"]).select("symbol", "i0", F.round(F.col("value") / F.col("vol"), 6).alias("value"))


_D = [round(float(x), 1) for x in np.linspace(0, 1, 11)]


def _ffd_sql(d: float) -> str:
    w = fractional_weights(d, 1e-2)
    return " + ".join(f"({v!r})::double * lag(ln(close), {k}) over o" if k else f"({v!r})::double * ln(close)" for k, v in enumerate(w))


@query("r11_least_difference", f"with {BARS}, g as (" + " union all ".join(f"select symbol, {d}::double as dd, bar_id, {_ffd_sql(d)} as v from bars window o as (partition by symbol order by bar_id)" for d in _D) + "), l as (select *, lag(v) over o as l1, lag(v, 2) over o as l2 from g window o as (partition by symbol, dd order by bar_id)), d as (select symbol, dd, v - l1 as y, l1 as a, l1 - l2 as b from l)" + _SUMS.format(k="symbol, dd") + " select symbol, min(case when t < -4 then dd end) as d from t group by symbol")
def r11(t):
    """The least d of the grid whose difference passes an ADF test at -4: all differences in one scan and window, one aggregation of sums keyed by d."""
    names = [f"v{k}" for k in range(len(_D))]
    v = t.bars.select("symbol", "bar_id", *[fractional_difference(F.ln("close"), d).alias(n) for n, d in zip(names, _D)])
    each = [F.struct(F.lit(d).alias("d"), F.col(n).alias("v"), lag(n).alias("l1"), lag(n, 2).alias("l2")) for n, d in zip(names, _D)]
    long = v.select("symbol", F.array(*each).alias("x")).select("symbol", F.explode("x").alias("x")).select("symbol", "x.*")
    long = long.select("symbol", "d", (F.col("v") - F.col("l1")).alias("y"), F.col("l1").alias("a"), (F.col("l1") - F.col("l2")).alias("b"))
    tests = long.groupBy("symbol", "d").agg(U.two_regressors("y", "a", "b")["t"].alias("t"))
    return tests.groupBy("symbol").agg(F.min(F.when(F.col("t") < -4, F.col("d"))).alias("d"))
