"""Queries of exponentially smoothed features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.smoothing import alpha_of, ema, ewm, wilder
from strandline.functions.windows import div, lag, roll, sma
from strandline.operators.events import cusum_events
from strandline.sources.tables import BARS

from . import sqltext as S
from .registry import query


def _value(df: DataFrame, value, digits: int = 6) -> DataFrame:
    return df.select("symbol", "bar_id", F.round(value, digits).alias("value"))


def _sql(adds: list[dict[str, str]], value: str, digits: int = 6) -> str:
    return S.steps(BARS, "bars", [*adds, {"v": value}], f"symbol, bar_id, round(v, {digits}) as value")


def s_sum(x: str, q: float) -> str:
    """The decayed sum as one sum of powers, which the few bars of the test data allow."""
    return f"(sum(coalesce({x}, 0) * pow({q!r}::double, -bar_id)) over p * pow({q!r}::double, bar_id))"


def s_ewm(x: str, span: float, mean: str, std: str | None = None, least: int = 0) -> list[dict[str, str]]:
    q, one = 1 - alpha_of(span), f"({x} is not null)::int"
    first = {f"{mean}_c": f"count({x}) over p", f"{mean}_w": s_sum(one, q), f"{mean}_s": s_sum(x, q), f"{mean}_w2": s_sum(one, q * q), f"{mean}_ss": s_sum(f"{x} * {x}", q)}
    seen = f"{mean}_c >= {max(1, least)}"
    out = {mean: f"case when {seen} then {mean}_s / nullif({mean}_w, 0) end"}
    if std:
        m = f"{mean}_s / nullif({mean}_w, 0)"
        out[std] = f"case when {seen} then sqrt(greatest({mean}_ss / nullif({mean}_w, 0) - ({m}) * ({m}), 0) * {mean}_w * {mean}_w / nullif({mean}_w * {mean}_w - {mean}_w2, 0)) end"
    return [first, out]


def s_ema(name: str, x: str, alpha: float, least: int = 0) -> list[dict[str, str]]:
    return [{f"{name}_c": f"count({x}) over p"}, {f"{name}_x": f"case when {name}_c = 1 then {x} / {alpha!r} else {x} end"}, {f"{name}_e": s_sum(f"{name}_x", 1 - alpha)}, {name: f"case when {name}_c >= {max(1, least)} then {alpha!r} * {name}_e end"}]


def s_wilder(name: str, x: str, n: int, mean: bool = False) -> list[dict[str, str]]:
    start = {f"{name}_c": f"count({x}) over p", f"{name}_0": f"sum({x}) over p"}
    return [start, {f"{name}_x": f"case when {name}_c = {n} then {name}_0 when {name}_c > {n} then {x} end"}, {f"{name}_e": s_sum(f"{name}_x", 1 - 1 / n)}, {name: f"case when {name}_c >= {n} then {name}_e / {n if mean else 1} end"}]


_LC = {"lc": "ln(close)"}


def _log(t) -> DataFrame:
    return t.bars.withColumn("lc", F.ln("close"))


def _macd(t) -> DataFrame:
    return ewm(ewm(_log(t), "lc", 12, mean="a", least=6), "lc", 26, mean="b", std="sd", least=13).withColumn("macd", F.col("a") - F.col("b"))


_MACD = [_LC, *s_ewm("lc", 12, "a", least=6), *s_ewm("lc", 26, "b", "sd", least=13), {"macd": "a - b"}]


@query("w2_macd_ewm", _sql(_MACD, "macd"))
def w2(t):
    return _value(_macd(t), F.col("macd"))


@query("w2_macd_histogram", _sql([*_MACD, *s_ewm("macd", 19, "sg", least=12)], "macd - sg"))
def w2_hist(t):
    return _value(ewm(_macd(t), "macd", 19, mean="sg", least=12), F.col("macd") - F.col("sg"))


@query("w2_macd_norm_ewm", _sql(_MACD, "macd / nullif(sd, 0)"))
def w2_norm(t):
    return _value(_macd(t), div(F.col("macd"), F.col("sd")))


# A lag of n bars is n + 1 rows back.
_BACK = {"back": "ln(close / lag(close, 7) over o)"}


@query("w5_roc_ewm", _sql([_BACK, *s_ewm("back", 10, "m")], "case when back is not null then m end"))
def w5(t):
    b = ewm(t.bars.withColumn("back", F.ln(F.col("close") / lag("close", 7))), "back", 10, mean="m")
    return _value(b, F.when(F.col("back").isNotNull(), F.col("m")))


@query("w6_ewm_volatility", _sql([_BACK, *s_ewm("back", 30, "m", "sd", least=10)], "case when back is not null then sd end"))
def w6(t):
    b = ewm(t.bars.withColumn("back", F.ln(F.col("close") / lag("close", 7))), "back", 30, std="sd", least=10)
    return _value(b, F.when(F.col("back").isNotNull(), F.col("sd")))


@query("f_ewm_mean", _sql([*s_ewm("close", 20, "m", least=5)], "m"))
def f_mean(t):
    return _value(ewm(t.bars, "close", 20, mean="m", least=5), F.col("m"))


@query("t10_trix", _sql([*s_ema("e1", "close", alpha_of(15), 15), *s_ema("e2", "e1", alpha_of(15), 15), *s_ema("e3", "e2", alpha_of(15), 15)], "(e3 - lag(e3) over o) / nullif(lag(e3) over o, 0) * 100"))
def t10(t):
    b = t.bars
    for new, old in (("e1", "close"), ("e2", "e1"), ("e3", "e2")):
        b = ema(b, new, old, alpha_of(15), 15)
    return _value(b, div(F.col("e3") - lag("e3"), lag("e3")) * 100)


def _stretch_sql(new: str, x: str, n: int = 10) -> dict[str, str]:
    lo, hi = S.roll("min", x, n), S.roll("max", x, n)
    return {new: f"100 * ({x} - {lo}) / nullif({hi} - {lo}, 0)"}


def _stretch(x: str, n: int = 10):
    lo, hi = roll(F.min, x, n), roll(F.max, x, n)
    return 100 * div(F.col(x) - lo, hi - lo)


@query("t14_schaff_trend_cycle", _sql([*s_ema("f", "close", alpha_of(23), 23), *s_ema("s", "close", alpha_of(50), 50), {"m": "f - s"}, _stretch_sql("k", "m"), *s_ema("d", "k", alpha_of(3), 3), _stretch_sql("kd", "d"), *s_ema("c", "kd", alpha_of(3), 3)], "c", 4))
def t14(t):
    b = ema(ema(t.bars, "f", "close", alpha_of(23), 23), "s", "close", alpha_of(50), 50).withColumn("m", F.col("f") - F.col("s"))
    b = ema(b.withColumn("k", _stretch("m")), "d", "k", alpha_of(3), 3)
    return _value(ema(b.withColumn("kd", _stretch("d")), "c", "kd", alpha_of(3), 3), F.col("c"), 4)


_UP, _DOWN = "high - lag(high) over o", "lag(low) over o - low"
_DM = [{"up": _UP, "dn": _DOWN, "tr": "case when lag(close) over o is not null then greatest(high - low, abs(high - lag(close) over o), abs(low - lag(close) over o)) end"}, {"pd": "case when up > dn and up > 0 then up when up is not null then 0 end", "md": "case when dn > up and dn > 0 then dn when dn is not null then 0 end"}]
_DI = [*_DM, *s_wilder("st", "tr", 14), *s_wilder("sp", "pd", 14), *s_wilder("sm", "md", 14), {"pi": "100 * sp / nullif(st, 0)", "mi": "100 * sm / nullif(st, 0)"}]


def _directions(t) -> DataFrame:
    from strandline.functions.windows import true_range

    b = t.bars.select("*", (F.col("high") - lag("high")).alias("up"), (lag("low") - F.col("low")).alias("dn"), true_range().alias("tr"))
    one = lambda x, y: F.when((F.col(x) > F.col(y)) & (F.col(x) > 0), F.col(x)).when(F.col(x).isNotNull(), 0.0)
    b = b.withColumns({"pd": one("up", "dn"), "md": one("dn", "up")})
    for new, x in (("st", "tr"), ("sp", "pd"), ("sm", "md")):
        b = wilder(b, new, x, 14)
    return b.withColumns({"pi": 100 * div(F.col("sp"), F.col("st")), "mi": 100 * div(F.col("sm"), F.col("st"))})


@query("t15_adx", _sql([*_DI, {"dx": "100 * abs(pi - mi) / nullif(pi + mi, 0)"}, *s_wilder("ad", "dx", 14, True)], "ad"))
def t15(t):
    b = _directions(t).withColumn("dx", 100 * div(F.abs(F.col("pi") - F.col("mi")), F.col("pi") + F.col("mi")))
    return _value(wilder(b, "ad", "dx", 14, True), F.col("ad"))


@query("t16_plus_di", _sql(_DI, "pi"))
def t16(t):
    return _value(_directions(t), F.col("pi"))


@query("t17_minus_di", _sql(_DI, "mi"))
def t17(t):
    return _value(_directions(t), F.col("mi"))


_RSI = [{"df": "close - lag(close) over o"}, {"g": "case when df is not null then greatest(df, 0) end", "l": "case when df is not null then greatest(-df, 0) end"}, *s_ema("eg", "g", 1 / 14, 14), *s_ema("el", "l", 1 / 14, 14), {"rsi": "100 * eg / nullif(eg + el, 0)"}, {"sr": f"(rsi - {S.roll('min', 'rsi', 14)}) / nullif({S.roll('max', 'rsi', 14)} - {S.roll('min', 'rsi', 14)}, 0)"}, {"k": S.roll("avg", "sr", 3)}]


def _stoch_rsi(t) -> DataFrame:
    b = t.bars.withColumn("df", F.col("close") - lag("close"))
    b = b.withColumns({"g": F.when(F.col("df").isNotNull(), F.greatest("df", F.lit(0.0))), "l": F.when(F.col("df").isNotNull(), F.greatest(-F.col("df"), F.lit(0.0)))})
    b = ema(ema(b, "eg", "g", 1 / 14, 14), "el", "l", 1 / 14, 14).withColumn("rsi", 100 * div(F.col("eg"), F.col("eg") + F.col("el")))
    lo, hi = roll(F.min, "rsi", 14), roll(F.max, "rsi", 14)
    return b.withColumn("sr", div(F.col("rsi") - lo, hi - lo)).withColumn("k", sma("sr", 3))


@query("t21_stoch_rsi", _sql(_RSI, "sr"))
def t21(t):
    return _value(_stoch_rsi(t), F.col("sr"))


@query("t22_stoch_rsi_k", _sql(_RSI, "k"))
def t22(t):
    return _value(_stoch_rsi(t), F.col("k"))


@query("t23_stoch_rsi_d", _sql(_RSI, S.roll("avg", "k", 3)))
def t23(t):
    return _value(_stoch_rsi(t), sma("k", 3))


@query("t24_true_strength", _sql([{"df": "close - lag(close) over o"}, {"ab": "abs(df)"}, *s_ema("d1", "df", alpha_of(25), 25), *s_ema("d2", "d1", alpha_of(13), 13), *s_ema("a1", "ab", alpha_of(25), 25), *s_ema("a2", "a1", alpha_of(13), 13)], "100 * d2 / nullif(a2, 0)"))
def t24(t):
    b = t.bars.withColumn("df", F.col("close") - lag("close")).withColumn("ab", F.abs("df"))
    for new, x, n in (("d1", "df", 25), ("d2", "d1", 13), ("a1", "ab", 25), ("a2", "a1", 13)):
        b = ema(b, new, x, alpha_of(n), n)
    return _value(b, 100 * div(F.col("d2"), F.col("a2")))


_PPO = [*s_ema("f", "close", alpha_of(12), 12), *s_ema("s", "close", alpha_of(26), 26), {"ppo": "(f - s) / nullif(s, 0) * 100"}]


def _ppo(t) -> DataFrame:
    b = ema(ema(t.bars, "f", "close", alpha_of(12), 12), "s", "close", alpha_of(26), 26)
    return b.withColumn("ppo", div(F.col("f") - F.col("s"), F.col("s")) * 100)


@query("t29_ppo", _sql(_PPO, "ppo"))
def t29(t):
    return _value(_ppo(t), F.col("ppo"))


@query("t30_ppo_signal", _sql([*_PPO, *s_ema("sg", "ppo", alpha_of(9), 9)], "sg"))
def t30(t):
    return _value(ema(_ppo(t), "sg", "ppo", alpha_of(9), 9), F.col("sg"))


_SAMPLING = [_LC, {"back": "ln(close / lag(close, 2) over o)", "dx": "lc - lag(lc) over o"}, *s_ewm("back", 50, "m", "sd", least=20), {"h": "sd / 2"}]
_HI, _LO = "greatest(0, w.hi + d.dx)", "least(0, w.lo + d.dx)"


@query("e4_cusum_sampling", S.steps(BARS, "bars", _SAMPLING, "", "").split("\nselect")[0] + f""", d as materialized (select symbol, bar_id, time, dx, h from step{len(_SAMPLING) - 1}),
w as (
  select symbol, bar_id, time, 0.0::double as hi, 0.0::double as lo, false as up, false as down from d where bar_id = 0
  union all
  select d.symbol, d.bar_id, d.time, case when coalesce({_HI} > h, false) then 0 else {_HI} end::double, case when coalesce({_LO} < -h, false) then 0 else {_LO} end::double, coalesce({_HI} > h, false), coalesce({_LO} < -h, false)
  from w join d on d.symbol = w.symbol and d.bar_id = w.bar_id + 1)
select symbol, time, bar_id, side::bigint as side from w, (values (-1), (1)) s(side) where (side = 1 and up) or (side = -1 and down)""")  # fmt: skip
def e4(t):
    """The cumulative-sum filter of log closes with half the smoothed volatility as threshold."""
    b = _log(t).withColumn("back", F.ln(F.col("close") / lag("close", 2)))
    return cusum_events(ewm(b, "back", 50, std="sd", least=20).withColumn("h", F.col("sd") / 2), "lc", "h")
