"""Queries of models over labelled bars: purged cross-validation, importances, components, stumps, and the grid over the sampling pipeline.

What a fitted model says is a few numbers, which become rows; trees and permutations have no SQL, tests hold them to planted features and closed forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.smoothing import ewm
from strandline.functions.windows import bollinger, lag, order, rsi
from strandline.operators import folds as K
from strandline.operators import models as M
from strandline.operators.grids import sampling_grid
from strandline.sources.scratch import cut
from strandline.sources.tables import BARS

from . import sqltext as S
from .registry import query
from .smoothed import s_ewm

FEATURES = ("z", "strength", "change", "turnover")


def frame(t) -> DataFrame:
    """Bars as events of ten bars: symbol, i0, i1, FEATURES, y (whether the close has risen by i1) and wt (by how much it changed)."""
    b = t.bars.withColumn("z", bollinger("close", 20)).withColumn("strength", rsi("close", 14)).withColumn("change", F.ln(F.col("close") / lag("close", 5)))
    b = b.withColumn("turnover", F.ln("dollar")).withColumn("later", F.lead("close", 10).over(order()))
    ret = F.ln(F.col("later") / F.col("close"))
    rows = b.select("symbol", F.col("bar_id").alias("i0"), (F.col("bar_id") + 10).alias("i1"), *FEATURES, (ret > 0).cast("int").alias("y"), F.abs(ret).alias("wt"))
    return rows.na.drop()


def parted(t, splits: int = 4) -> DataFrame:
    """The frame with its purged folds; written once, as models read it many times."""
    f = frame(t)
    return cut(f.join(K.fold_columns(f, splits, 0.02), ["symbol", "i0"]))


def _rows(t, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame([tuple(x if isinstance(x, str) else float(x) for x in r) for r in rows], schema)


@query("k2_fold_columns", S.steps(BARS, "bars", [{"lc": "ln(close)", "r": "ln(close / lag(close) over o)"}, {"z": S.z("lc", 20), "g": "greatest(r, 0)", "d": "greatest(-r, 0)", "ch": "ln(close / lag(close, 5) over o)", "later": "lead(close, 10) over o"}, {"st": "case when count(r) over w14 = 14 then sum(g) over w14 / nullif(sum(g) over w14 + sum(d) over w14, 0) end"}], "", "").split("\nselect")[0] + """,
f as (select symbol, bar_id as i0, bar_id + 10 as i1 from step2 where z is not null and st is not null and ch is not null and later is not null),
e as (select symbol, i0, i1, ntile(4) over (partition by symbol order by i0) as own, row_number() over (partition by symbol order by i0) - 1 as k, count(*) over (partition by symbol) as n from f),
b as (select symbol, own as fold, min(i0) as t0, max(i1) as t1, floor(any_value(n) * 0.02::double) as gap from e group by symbol, own),
a as (select b.*, (select min(k) from e where e.symbol = b.symbol and e.i0 >= b.t1) as r from b)
select e.symbol, e.i0, any_value(e.own - 1)::int as fold, string_agg((a.fold - 1)::varchar, ',' order by a.fold) filter (e.own <> a.fold and (e.i1 <= a.t0 or e.k >= a.r + a.gap)) as trains from e join a on a.symbol = e.symbol group by e.symbol, e.i0""")  # fmt: skip
def k2_columns(t):
    """Purged folds in one row for each event."""
    trains = F.array_join("trains", ",")
    return parted(t).select("symbol", "i0", "fold", F.when(trains != "", trains).alias("trains"))


@query("k3_cross_validation")
def k3_cv(t):
    """Log loss over purged folds of logistic regressions of several strengths of regularisation."""
    _, scores = M.purged_scores(parted(t), FEATURES, (0.1, 1.0, 10.0), 4)
    return _rows(t, scores, "c double, score double, deviation double")


@query("k5_components")
def k5(t):
    """Rows in the fewest components that explain 95% of the variance: the mean and deviation of each component by symbol."""
    rows = frame(t)
    model, _ = M.components(rows, FEATURES, 0.95)
    from pyspark.ml.functions import vector_to_array

    c = model.transform(rows).select("symbol", F.posexplode(vector_to_array("pca")).alias("component", "value"))
    return c.groupBy("symbol", "component").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"))


@query("k6_impurity_importance")
def k6(t):
    imp = M.impurity_importance(M.forest(cut(frame(t)), FEATURES, trees=50), FEATURES)
    return _rows(t, [(f, m, e) for f, (m, e) in imp.items()], "feature string, mean double, error double")


@query("k6_gain_importance")
def k6_gain(t):
    imp = M.gain_importance(M.boosted(cut(frame(t)), FEATURES, rounds=8), FEATURES)
    return _rows(t, list(imp.items()), "feature string, gain double")


def _train_test(t) -> tuple[DataFrame, DataFrame]:
    rows = parted(t)
    return rows.where(F.array_contains("trains", 3)), rows.where("fold = 3")


@query("k7_permutation_importance")
def k7(t):
    """On the last purged fold: the share of the log loss that each feature's permutation adds."""
    train, test = _train_test(t)
    return _rows(t, list(M.permutation_importance(train, test, lambda d: M.logistic(d, FEATURES), FEATURES).items()), "feature string, importance double")


@query("k8_single_importance")
def k8(t):
    train, test = _train_test(t)
    return _rows(t, list(M.single_importance(train, test, lambda d, f: M.logistic(d, f), FEATURES).items()), "feature string, accuracy double")


@query("k9_stump_forest")
def k9(t):
    """A forest of stumps, then one of the features that the first used: the test rows' probabilities, summed up by symbol."""
    train, test = _train_test(t)
    used = M.used_features(M.forest(train, FEATURES, trees=50), FEATURES) or list(FEATURES)
    p = M.probabilities(M.forest(train, used, trees=50), test)
    return p.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))


@query("k10_logistic_bets")
def k10(t):
    """Bets of max(2p - 1, 0) on the last purged fold by a weighted logistic regression."""
    train, test = _train_test(t)
    p = M.probabilities(M.logistic(train, FEATURES), test).withColumn("bet", F.greatest(2 * F.col("p") - 1, F.lit(0.0)))
    r = F.log1p(F.col("bet") * F.expm1(F.when(F.col("y") == 1, F.col("wt")).otherwise(-F.col("wt"))))
    return p.groupBy("symbol").agg(F.sum("bet").alias("bets"), F.sum(r).alias("lret"))


@query("k12_stump_entropy")
def k12(t):
    rows = cut(frame(t))
    return _rows(t, [(f, M.entropy_decrease(rows, f)) for f in FEATURES], "feature string, decrease double")


_SETS = tuple({"h_mul": h, "hold": hold, "barrier": b} for h in (1.0, 2.0) for hold in (12.0, 36.0) for b in (0.5, 1.0))
_D = [{"lc": "ln(close)", "back": "ln(close / lag(close, 2) over o)"}, *s_ewm("back", 50, "m", "sd", least=20), {"dx": "lc - lag(lc) over o"}]
_HI, _LO = "greatest(0, w.hi + d.dx)", "least(0, w.lo + d.dx)"


def _grid_sql() -> str:
    values = ", ".join(f"({k}, {p['h_mul']}::double, {int(p['hold'])}, {p['barrier']}::double)" for k, p in enumerate(_SETS))
    return S.steps(BARS, "bars", _D, "", "").split("\nselect")[0] + f""",
p(k, h_mul, hold, barrier) as (values {values}),
d as materialized (select k, h_mul, hold, barrier, symbol, bar_id, close, dx, sd * h_mul as h, sd * barrier as v from step{len(_D) - 1}, p),
w as (
  select k, symbol, bar_id, 0.0::double as hi, 0.0::double as lo, false as hit from d where bar_id = 0
  union all
  select d.k, d.symbol, d.bar_id, case when coalesce({_HI} > h, false) then 0 else {_HI} end::double, case when coalesce({_LO} < -h, false) then 0 else {_LO} end::double, coalesce({_HI} > h, false) or coalesce({_LO} < -h, false)
  from w join d on d.k = w.k and d.symbol = w.symbol and d.bar_id = w.bar_id + 1),
ev as (select d.k, d.symbol, d.bar_id as i0, d.close as p0, d.v, d.hold from w join d on d.k = w.k and d.symbol = w.symbol and d.bar_id = w.bar_id where w.hit),
fin as (select symbol, max(bar_id) as fin from bars group by symbol),
t as (
  select e.k, e.symbol, e.i0, any_value(e.p0) as p0, least(any_value(e.i0 + e.hold), min(case when b.close / e.p0 - 1 > e.v then b.bar_id end), min(case when b.close / e.p0 - 1 < -e.v then b.bar_id end), any_value(fin.fin)) as i1
  from ev e join bars b on b.symbol = e.symbol and b.bar_id between e.i0 and e.i0 + e.hold join fin on fin.symbol = e.symbol group by e.k, e.symbol, e.i0),
c as (select t.k, b.symbol, b.bar_id, count(*) as held from bars b join t on t.symbol = b.symbol and b.bar_id between t.i0 and t.i1 group by t.k, b.symbol, b.bar_id),
u as (select t.k, t.symbol, t.i0, any_value(t.p0) as p0, any_value(t.i1) as i1, avg(1.0::double / held) as weight from t join c on c.k = t.k and c.symbol = t.symbol and c.bar_id between t.i0 and t.i1 group by t.k, t.symbol, t.i0),
g as (select u.k, u.symbol, count(*) as n, avg(weight) as uniqueness, avg(abs(b.close / u.p0 - 1)) as abs_ret from u join bars b on b.symbol = u.symbol and b.bar_id = u.i1 group by u.k, u.symbol)
select g.symbol, p.h_mul, p.hold::double as hold, p.barrier, n, round(uniqueness, 6) as uniqueness, round(abs_ret, 6) as abs_ret, round(uniqueness * (abs_ret - 0.001) * n, 4) as score from g join p on p.k = g.k"""


@query("k13_sampling_grid", _grid_sql())
def k13(t):
    """Score of every parameter set of the sampling pipeline, by symbol."""
    b = ewm(t.bars.withColumn("back", F.ln(F.col("close") / lag("close", 2))), "back", 50, std="sd", least=20)
    g = sampling_grid(b, "sd", _SETS)
    return g.select("symbol", "h_mul", "hold", "barrier", "n", F.round("uniqueness", 6).alias("uniqueness"), F.round("abs_ret", 6).alias("abs_ret"), F.round("score", 4).alias("score"))
