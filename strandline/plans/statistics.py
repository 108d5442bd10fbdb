"""Queries of statistics of paths, of encodings and of rolling regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.windows import bfill, ffill, gate, lag, w
from strandline.operators import statistics as R
from strandline.operators.paths import ols, path
from strandline.sources.tables import PAIR

from . import sqltext as S
from .events import EV, falling
from .registry import query

_P = EV + ", p as (select e.symbol, e.i0, b.bar_id - e.i0 + {m} as step, {x} as value from ev e join {t} b on b.symbol = e.symbol and b.bar_id between e.i0 - {m} and e.i0)"
_RETS = ", r as (select *, ln(close / lag(close) over (partition by symbol order by bar_id)) as ret, volume * case when close >= open then 0.2::double else -0.2::double end as net from bars)"
_BY = "over (partition by symbol, i0 order by step)"


def _p(n: int, x: str = "b.close") -> str:
    return _P.format(m=n - 1, x=x, t="bars")


def _closes(t, n: int) -> DataFrame:
    return path(falling(t), t.bars, "close", n)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("value", F.round("value", digits))


def _moves(t) -> DataFrame:
    return t.bars.select("*", F.ln(F.col("close") / lag("close")).alias("ret"), (F.col("volume") * F.when(F.col("close") >= F.col("open"), 0.2).otherwise(-0.2)).alias("net"))


@query("r2_trend_residual", _p(12) + """, g as (select symbol, i0, count(value) as n, regr_slope(value, step) as b, regr_intercept(value, step) as a, regr_syy(value, step) as syy, regr_sxy(value, step) as sxy, arg_max(value, step) as y, max(step) as x from p group by symbol, i0)
select symbol, i0, round(case when n >= 10 then (y - a - b * x) / nullif(sqrt(greatest(syy - b * sxy, 0) / n), 0) end, 5) as value from g""")  # fmt: skip
def r2(t):
    return _rounded(R.last_residual(_closes(t, 12)), 5)


@query("r3_ar1", _p(20) + f""", q as (select *, lag(value) {_BY} as x0, row_number() {_BY} as k from p), q1 as (select symbol, i0, value, case when k > 2 then x0 end as x from q),
g as (select symbol, i0, regr_count(value, x) as n, regr_slope(value, x) as b, regr_sxx(value, x) as sxx, regr_syy(value, x) as syy, regr_sxy(value, x) as sxy from q1 group by symbol, i0)
select symbol, i0, round(case when n > 2 then sign(b) * b / nullif(sqrt(greatest(syy - b * sxy, 0) / (n - 2) / nullif(sxx, 0)), 0) end, 4) as value from g""")  # fmt: skip
def r3(t):
    return _rounded(R.ar1(_closes(t, 20)), 4)


_LAGS = range(2, 7)


@query("r9_hurst", _p(30) + f", q as (select *, ln(value / lag(value) {_BY}) as r from p), d as (select symbol, i0, " + ", ".join(f"r - lag(r, {k}) {_BY} as d{k}" for k in _LAGS) + " from q), g as (select symbol, i0, " + ", ".join(f"var_pop(d{k}) as v{k}" for k in _LAGS) + " from d group by symbol, i0), l as (" + " union all ".join(f"select symbol, i0, ln({k}.0::double) as x, case when v{k} > 0 then ln(v{k}) end as y from g" for k in _LAGS) + ") select symbol, i0, round(regr_sxy(y, x) / nullif(regr_sxx(y, x), 0) / 2, 5) as value from l group by symbol, i0")
def r9(t):
    return _rounded(R.hurst(_closes(t, 30), _LAGS), 5)


def _lambda_sql(y: str, x: str) -> str:
    return EV + _RETS + f""", p as (select e.symbol, e.i0, {y} as y, {x} as x from ev e join r b on b.symbol = e.symbol and b.bar_id between e.i0 - 19 and e.i0),
g as (select symbol, i0, sum(x * y) as xy, sum(x * x) as xx, sum(y * y) as yy, count(*) as n from p where x is not null and y is not null group by symbol, i0)
select symbol, i0, round(xy / nullif(xx, 0) / nullif(sqrt(greatest(yy - xy / nullif(xx, 0) * xy, 0) / nullif((n - 1) * xx, 0)), 0), 4) as value from g"""


def _lambda(t, y, x) -> DataFrame:
    b = _moves(t).select("symbol", "bar_id", y.alias("y"), x.alias("x"))
    e = falling(t)
    both = path(e, b, "y", 20).withColumnRenamed("value", "y").join(path(e, b, "x", 20).withColumnRenamed("value", "x"), ["symbol", "i0", "step"])
    return _rounded(R.through_origin(both.where("y is not null and x is not null"), "y", "x"), 4)


_SIMPLE = "(exp(b.ret) - 1)"


@query("r12_kyle_lambda", _lambda_sql(_SIMPLE, "b.net"))
def r12(t):
    return _lambda(t, F.exp("ret") - 1, F.col("net"))


@query("r13_amihud_lambda", _lambda_sql("abs(b.ret)", "b.net * b.close"))
def r13(t):
    return _lambda(t, F.abs("ret"), F.col("net") * F.col("close"))


@query("r14_hasbrouck_lambda", _lambda_sql("b.ret", "sign(b.net) * sqrt(abs(b.net * b.close))"))
def r14(t):
    return _lambda(t, F.col("ret"), F.signum("net") * F.sqrt(F.abs(F.col("net") * F.col("close"))))


@query("r15_roll_model", EV + _RETS + f""", p as (select e.symbol, e.i0, b.bar_id as step, b.ret as value from ev e join r b on b.symbol = e.symbol and b.bar_id between e.i0 - 19 and e.i0),
q as (select *, lead(value) {_BY} as nxt from p) select symbol, i0, round(var_samp(value) - 2 * covar_samp(value, nxt), 6) as value from q group by symbol, i0""")  # fmt: skip
def r15(t):
    return _rounded(R.roll_variance(path(falling(t), _moves(t), "ret", 20)))


_MSG = EV + _RETS + """, m as (select e.symbol, e.i0, string_agg(case when b.ret > 0 then '1' else '0' end, '' order by b.bar_id) as msg from ev e join r b on b.symbol = e.symbol and b.bar_id between e.i0 - 19 and e.i0 where b.ret is not null group by e.symbol, e.i0)"""


def _messages(t) -> DataFrame:
    return R.signs(path(falling(t), _moves(t), "ret", 20))


@query("n1_binary_encoding", _MSG + " select symbol, i0, msg from m")
def n1(t):
    return _messages(t)


@query("n4_plug_in_entropy", _MSG + """, g as (select symbol, i0, unnest(list_transform(range(1, length(msg) - 1), lambda k: substring(reverse(msg), k, 2))) as g from m where length(msg) > 2),
c as (select symbol, i0, g, count(*) as n from g group by all), p as (select *, n / sum(n) over (partition by symbol, i0) as p from c) select symbol, i0, round(-sum(p * log2(p)) / 2, 6) as value from p group by symbol, i0""")  # fmt: skip
def n4(t):
    return _rounded(R.plug_in_entropy(_messages(t), "msg", 2))


@query("n6_runs_test", _MSG + """, c as (select *, length(replace(msg, '1', ''))::double as a, length(replace(msg, '0', ''))::double as b, length(regexp_replace(regexp_replace(msg, '0+', '0', 'g'), '1+', '1', 'g')) as runs from m)
select symbol, i0, round((runs - (2 * a * b / (a + b) + 1)) / nullif(sqrt(2 * a * b * (2 * a * b - a - b) / nullif((a + b) * (a + b) * (a + b - 1), 0)), 0), 6) as value from c""")  # fmt: skip
def n6(t):
    return _messages(t).select("symbol", "i0", F.round(R.runs_test(F.col("msg")), 6).alias("value"))


_FIT = "case when regr_count(y, x) over w30 = 30 then {} end"


@query("p14_rolling_regression", S.steps(PAIR, "pair", [{"slope": _FIT.format("regr_sxy(y, x) over w30 / nullif(regr_sxx(y, x) over w30, 0)")}], "symbol, bar_id, round(slope, 6) as slope"))
def p14(t):
    slope = F.try_divide(F.regr_sxy("y", "x").over(w(30)), F.regr_sxx("y", "x").over(w(30)))
    return t.pair.select("symbol", "bar_id", F.round(gate(slope, "x", 30), 6).alias("slope"))


@query("p13_rolling_correlation", S.steps(PAIR, "pair", [{"c": _FIT.format("covar_samp(y, x) over w30 / nullif(stddev_samp(y) over w30 * stddev_samp(x) over w30, 0)")}], "symbol, bar_id, round(c * 30 / 29, 6) as value"))
def p13(t):
    """The product of standard scores by population deviations, over n - 1: the correlation times n / (n - 1)."""
    c = F.try_divide(F.covar_samp("y", "x").over(w(30)), F.stddev_samp("y").over(w(30)) * F.stddev_samp("x").over(w(30)))
    return t.pair.select("symbol", "bar_id", F.round(gate(c, "x", 30) * 30 / 29, 6).alias("value"))


@query("p11_path_regression", EV + """, p as (select e.symbol, e.i0, b.close as y, b.volume as x from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 - 19 and e.i0),
g as (select symbol, i0, count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy from p group by symbol, i0)
select symbol, i0, round(b, 6) as slope, round(a, 6) as intercept, round(sqrt(greatest(syy - b * sxy, 0) / (n - 1)), 6) as resid from g where n = 20""")  # fmt: skip
def p11(t):
    e, f = falling(t), ols("y", "x")
    both = path(e, t.bars, "close", 20).withColumnRenamed("value", "y").join(path(e, t.bars, "volume", 20).withColumnRenamed("value", "x"), ["symbol", "i0", "step"])
    g = both.groupBy("symbol", "i0").agg(F.count("y").alias("n"), *[F.round(f[k], 6).alias(k) for k in ("slope", "intercept", "resid")])
    return g.where("n = 20").drop("n")


@query("p15_sampled_beta", S.steps(PAIR, "pair", [{"b": "case when bar_id >= 19 and (bar_id - 19) % 10 = 0 and regr_count(y, x) over w20 = 20 then regr_sxy(y, x) over w20 / nullif(regr_sxx(y, x) over w20, 0) end"}, {"m": "case when b is not null then avg(b) over r_29p_0 end"}, {"f": "coalesce(last_value(m ignore nulls) over p, first_value(m ignore nulls) over s)"}], "symbol, bar_id, round(f, 6) as beta"))
def p15(t):
    """A regression every ten bars, the mean of the last three slopes, carried forward and, before the first, back."""
    slope = F.try_divide(F.regr_sxy("y", "x").over(w(20)), F.regr_sxx("y", "x").over(w(20)))
    d = t.pair.withColumn("b", F.when((F.col("bar_id") >= 19) & ((F.col("bar_id") - 19) % 10 == 0), gate(slope, "x", 20)))
    d = d.withColumn("m", F.when(F.col("b").isNotNull(), F.avg("b").over(w(30))))
    return d.select("symbol", "bar_id", F.round(F.coalesce(ffill("m"), bfill("m")), 6).alias("beta"))
