"""Rolling features: one query for each, a value for every bar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from strandline.functions import windows as W
from strandline.functions.windows import between, col, div, gate, lag, order, prefix, roll, sma, w
from strandline.operators.blocks import by_block
from strandline.sources.tables import BARS, TICKS

from . import sqltext as S
from .registry import query

N = 20


#: What the rolling features look at together with what they are made of, in bars; those that look at all history are in HISTORY.
BACK, AHEAD = 256, 32
HISTORY = ("c11_forward_back_fill", "m15_cumulative_return", "w3_williams_r", "w12_run_length")
FEATURES: dict[str, Callable] = {}


def feature(name: str, adds: list[dict[str, tuple[Callable[[], Column], str]]], digits: int = 6) -> None:
    """A query of the last column added to the bars, rounded. Each column is given for Spark, to be made when the query runs, and for SQL; a dict is one step."""
    value = list(adds[-1])[-1]
    sql = S.steps(BARS, "bars", [{k: v[1] for k, v in a.items()} for a in adds], f"symbol, bar_id, round(({value})::double, {digits}) as value")

    def add(df):
        for a in adds:
            df = df.select("*", *[v[0]().alias(k) for k, v in a.items()])
        return df

    def of(bars, block: int | None = 4096):
        df = add(bars) if block is None or name in HISTORY else by_block(bars, add, BACK, AHEAD, block)
        return df.select("symbol", "bar_id", F.round(F.col(value).cast("double"), digits).alias("value"))

    FEATURES[name] = of

    @query(name, sql)
    def run(t):
        return of(t.bars)


LC = {"lc": (lambda: F.ln("close"), "ln(close)")}
RET = {"ret": (lambda: F.ln(F.col("close") / lag("close")), "ln(close / lag(close) over o)")}


def atr_steps(n: int = 30) -> list[dict]:
    """True range, then its mean as column atr."""
    tr = "case when lag(close) over o is not null then greatest(high - low, abs(high - lag(close) over o), abs(low - lag(close) over o)) end"
    return [{"tr": (lambda: W.true_range(), tr)}, {"atr": (lambda: sma("tr", n), S.roll("avg", "tr", n))}]


feature("w1_bollinger", [LC, {"value": (lambda: W.zscore("lc", N), S.z("lc", N))}])
feature("w2_macd_sma", [LC, {"value": (lambda: 
    div(gate(F.avg("lc").over(w(12)), "lc", 12, least=6) - gate(F.avg("lc").over(w(26)), "lc", 26, least=13), gate(F.stddev_samp("lc").over(w(26)), "lc", 26, least=13)),
    "(case when count(lc) over w12 >= 6 then avg(lc) over w12 end - case when count(lc) over w26 >= 13 then avg(lc) over w26 end) / nullif(case when count(lc) over w26 >= 13 then stddev_samp(lc) over w26 end, 0)")}])
_K, _L = 3, 20


def _pivot(f, ok) -> Column:
    before, after = (gate(f("close").over(between(a, b)), "close", _K, between(a, b)) for a, b in ((-_K, -1), (1, _K)))
    return F.when(ok(before, F.col("close")) & ok(after, F.col("close")), F.col("close"))


def _pivot_sql(f: str, op: str) -> str:
    side = lambda r: f"case when count(close) over {r} = {_K} then {f}(close) over {r} end"
    return f"case when {side('r_3p_1p')} {op} close and {side('r_1f_3f')} {op} close then close end"


feature("w3_williams_r", [
    {"ph": (lambda: _pivot(F.max, lambda a, b: a <= b), _pivot_sql("max", "<=")), "pl": (lambda: _pivot(F.min, lambda a, b: a >= b), _pivot_sql("min", ">="))},
    {"rh": (lambda: F.max("ph").over(between(1 - _L, -_K)), "max(ph) over r_19p_3p"), "rl": (lambda: F.min("pl").over(between(1 - _L, -_K)), "min(pl) over r_19p_3p")},
    {"fh": (lambda: W.ffill("rh"), "last_value(rh ignore nulls) over p"), "fl": (lambda: W.ffill("rl"), "last_value(rl ignore nulls) over p")},
    {"value": (lambda: div(F.col("close") - F.col("fl"), F.col("fh") - F.col("fl")), "(close - fl) / nullif(fh - fl, 0)")}])
_GAIN = {"g": (lambda: F.greatest("ret", F.lit(0.0)), "case when ret is not null then greatest(ret, 0) end"), "b": (lambda: F.when(F.col("ret").isNotNull(), F.greatest(-F.col("ret"), F.lit(0.0))), "case when ret is not null then greatest(-ret, 0) end")}
_GAIN["g"] = (lambda: F.when(F.col("ret").isNotNull(), F.greatest("ret", F.lit(0.0))), _GAIN["g"][1])
feature("w4_rsi", [RET, _GAIN, {"value": (lambda: gate(div(F.sum("g").over(w(14)), F.sum("g").over(w(14)) + F.sum("b").over(w(14))), "ret", 14), S.gate(14, "sum(g) over w14 / nullif(sum(g) over w14 + sum(b) over w14, 0)", "ret"))}])
feature("w4_roc", [RET, {"value": (lambda: roll(F.sum, "ret", N), S.roll("sum", "ret", N))}])
feature("w4_roc_norm", [RET, {"value": (lambda: div(roll(F.sum, "ret", N), roll(F.stddev_samp, "ret", N)), f"{S.roll('sum', 'ret', N)} / nullif({S.roll('stddev_samp', 'ret', N)}, 0)")}])
feature("w5_roc_lag", [{"value": (lambda: F.ln(F.col("close") / lag("close", 6)), "ln(close / lag(close, 6) over o)")}])
feature("w7_atr", atr_steps())
feature("w8_sma", [{"value": (lambda: sma("close", 30), S.roll("avg", "close", 30))}])
_VWAP = {"vw": (lambda: W.vwap(30), S.gate(30, "sum(close * volume) over w30 / nullif(sum(volume) over w30, 0)", "volume"))}
feature("w8_vwap", [_VWAP])
feature("w8_vwstd", [_VWAP, {"sq": (lambda: F.pow(F.col("close") - F.col("vw"), 2) * F.col("volume"), "(close - vw) * (close - vw) * volume")}, {"value": (lambda: F.sqrt(div(roll(F.sum, "sq", 30), roll(F.sum, "volume", 30))), f"sqrt({S.roll('sum', 'sq', 30)} / nullif({S.roll('sum', 'volume', 30)}, 0))")}])
_LV = {"lv": (lambda: F.ln(F.col("volume") + 2.719), "ln(volume + 2.719)")}
feature("w9_price_volume_z", [*atr_steps(), _LV, {"pv": (lambda: F.col("lv") * F.col("close"), "lv * close")}, {"value": (lambda: div(F.col("pv") - sma("pv", 30), F.col("atr") * F.col("lv")), f"(pv - {S.roll('avg', 'pv', 30)}) / nullif(atr * lv, 0)")}])
feature("w9_volume_z", [_LV, {"value": (lambda: W.zscore("lv", 30), S.z("lv", 30))}])
feature("w10_bollinger_vwap", [_VWAP, {"value": (lambda: div(F.col("close") - F.col("vw"), roll(F.stddev_samp, "close", 30)), f"(close - vw) / nullif({S.roll('stddev_samp', 'close', 30)}, 0)")}])
feature("w10_bollinger_std", [{"value": (lambda: W.zscore("close", 30), S.z("close", 30))}])
feature("w11_normalizer_atr", [*atr_steps(N), {"value": (lambda: F.nullif("atr", F.lit(0.0)), "nullif(atr, 0)")}])
feature("w11_normalizer_std", [{"value": (lambda: F.nullif(roll(F.stddev_samp, "close", N), F.lit(0.0)), f"nullif({S.roll('stddev_samp', 'close', N)}, 0)")}])
feature("w11_normalizer_close", [{"value": (lambda: F.nullif(lag("close", N), F.lit(0.0)), f"nullif(lag(close, {N}) over o, 0)")}])
feature("w12_run_length", [
    {"up": (lambda: F.coalesce(F.col("close") > lag("close"), F.lit(False)).cast("int"), "coalesce(close > lag(close) over o, false)::int"), "dn": (lambda: F.coalesce(F.col("close") < lag("close"), F.lit(False)).cast("int"), "coalesce(close < lag(close) over o, false)::int")},
    {"ch": (lambda: F.coalesce((F.col("up") != lag("up")).cast("int"), F.lit(1)), "coalesce((up <> lag(up) over o)::int, 1)")}, {"grp": (lambda: F.sum("ch").over(prefix()), "sum(ch) over p")},
    {"value": (lambda: F.sum(F.col("up") - F.col("dn")).over(order().partitionBy("symbol", "grp").rowsBetween(Window.unboundedPreceding, 0)), "sum(up - dn) over (partition by symbol, grp order by bar_id rows unbounded preceding)")}])
_DIG = {"dig": (lambda: F.substring(F.regexp_replace(F.col("close").cast("string"), "[.0]", ""), 1, 2), "substring(regexp_replace(close::varchar, '[.0]', '', 'g'), 1, 2)")}
feature("w13_leading_digit_cross", [_DIG, {"value": (lambda: F.coalesce(F.signum((F.col("dig") > lag("dig")).cast("int") - (F.col("dig") < lag("dig")).cast("int")), F.lit(0.0)), "coalesce((dig > lag(dig) over o)::int - (dig < lag(dig) over o)::int, 0)")}])
_TAKER = {"tk": (lambda: F.col("volume") * F.when(F.col("close") >= F.col("open"), 0.6).otherwise(0.4), "volume * case when close >= open then 0.6 else 0.4 end")}
# In tenths, so that sums are of integers and both engines divide the same two.
_TENTHS = {"tk": (lambda: F.col("volume") * F.when(F.col("close") >= F.col("open"), 6).otherwise(4), "volume * case when close >= open then 6 else 4 end")}
feature("w14_taker_ratio", [_TENTHS, {"value": (lambda: div(roll(F.sum, "tk", 30), 10 * roll(F.sum, "volume", 30)), f"{S.roll('sum', 'tk', 30)} / nullif(10 * {S.roll('sum', 'volume', 30)}, 0)")}])
feature("w16_next_sum", [{"value": (lambda: gate(F.sum("close").over(between(1, 5)), "close", 5, between(1, 5)), "case when count(close) over r_1f_5f = 5 then sum(close) over r_1f_5f end")}])
feature("w17_signed_cusum", [RET, {"vol": (lambda: roll(F.stddev_samp, "ret", N), S.roll("stddev_samp", "ret", N))}, {"pos": (lambda: F.when(F.col("ret").isNotNull(), div(F.greatest("ret", F.lit(0.0)), F.col("vol"))), "case when ret is not null then greatest(ret, 0) / nullif(vol, 0) end")}, {"value": (lambda: roll(F.sum, "pos", N) / F.sqrt(F.lit(float(N))), f"{S.roll('sum', 'pos', N)} / sqrt({N}.0)")}])
feature("w18_vpin", [_TAKER, {"net": (lambda: 2 * F.col("tk") - F.col("volume"), "2 * tk - volume")}, {"value": (lambda: sma("net", N), S.roll("avg", "net", N))}])
feature("w18_high_low", [{"hl": (lambda: F.ln(F.col("high") / F.col("low")), "ln(high / low)")}, {"value": (lambda: sma("hl", N), S.roll("avg", "hl", N))}])
_DEN = 3 - 2 * 2**0.5
feature("w19_corwin_schultz", [
    {"hl": (lambda: F.pow(F.ln(F.col("high") / F.col("low")), 2), "power(ln(high / low), 2)")}, {"b2": (lambda: roll(F.sum, "hl", 2), S.roll("sum", "hl", 2)), "gm": (lambda: F.pow(F.ln(roll(F.max, "high", 2) / roll(F.min, "low", 2)), 2), f"power(ln({S.roll('max', 'high', 2)} / {S.roll('min', 'low', 2)}), 2)")},
    {"be": (lambda: sma("b2", 3), S.roll("avg", "b2", 3))}, {"al": (lambda: F.when(F.col("be").isNotNull(), F.greatest((2**0.5 - 1) * F.sqrt("be") / _DEN - F.sqrt(F.col("gm") / _DEN), F.lit(0.0))), f"case when be is not null then greatest({2**0.5 - 1} * sqrt(be) / {_DEN} - sqrt(gm / {_DEN}), 0) end")},
    {"value": (lambda: 2 * (F.exp("al") - 1) / (1 + F.exp("al")), "2 * (exp(al) - 1) / (1 + exp(al))")}])
_FD = W.fractional_weights(0.4, 0.02)
feature("r10_fractional_difference", [LC, {"value": (lambda: W.fractional_difference("lc", 0.4, 0.02), " + ".join([f"{_FD[0]} * lc"] + [f"({v}) * lag(lc, {k}) over o" for k, v in enumerate(_FD) if k]))}])
feature("p3_past_value_bars", [{"value": (lambda: lag("close", 6), "lag(close, 6) over o")}])
feature("e11_signal_weight", [
    {"sg": (lambda: (F.col("close") > F.col("open")).cast("int"), "(close > open)::int")}, {"ov": (lambda: F.coalesce(F.sum("sg").over(between(-5, -1)), F.lit(0)), "coalesce(sum(sg) over r_5p_1p, 0)")},
    {"iv": (lambda: F.when(F.col("ov") > 0, 1.0 / F.col("ov") / 5).otherwise(0.0), "case when ov > 0 then 1.0::double / ov / 5 else 0 end")},
    {"value": (lambda: F.coalesce(F.sum("iv").over(between(1, 5)), F.lit(0.0)) * F.col("sg"), "coalesce(sum(iv) over r_1f_5f, 0) * sg")}])
feature("c11_forward_back_fill", [{"x": (lambda: F.when(F.col("close") > F.col("open"), F.col("close")), "case when close > open then close end")}, {"value": (lambda: F.coalesce(W.ffill("x"), W.bfill("x")), "coalesce(last_value(x ignore nulls) over p, first_value(x ignore nulls) over s)")}])
feature("m15_cumulative_return", [RET, {"value": (lambda: F.sum("ret").over(prefix()), "sum(ret) over p")}])

# Indicators by their public definitions, over n bars.
_TP = {"tp": (lambda: (F.col("high") + F.col("low") + F.col("close")) / 3, "(high + low + close) / 3")}
feature("t1_chaikin_money_flow", [{"mf": (lambda: F.coalesce(div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low")), F.lit(0.0)) * F.col("volume"), "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume")}, {"value": (lambda: div(roll(F.sum, "mf", N), roll(F.sum, "volume", N)), f"{S.roll('sum', 'mf', N)} / nullif({S.roll('sum', 'volume', N)}, 0)")}])
feature("t2_money_flow_index", [_TP, {"dr": (lambda: F.signum(F.col("tp") - lag("tp")), "sign(tp - lag(tp) over o)")}, {"up": (lambda: F.when(F.col("dr") > 0, F.col("tp") * F.col("volume")).when(F.col("dr").isNotNull(), 0.0), "case when dr > 0 then tp * volume when dr is not null then 0 end"), "dn": (lambda: F.when(F.col("dr") < 0, F.col("tp") * F.col("volume")).when(F.col("dr").isNotNull(), 0.0), "case when dr < 0 then tp * volume when dr is not null then 0 end")}, {"value": (lambda: 100 * div(roll(F.sum, "up", 14), roll(F.sum, "up", 14) + roll(F.sum, "dn", 14)), f"100 * {S.roll('sum', 'up', 14)} / nullif({S.roll('sum', 'up', 14)} + {S.roll('sum', 'dn', 14)}, 0)")}])
_MS = {"ma": (lambda: sma("close", N), S.roll("avg", "close", N)), "sd": (lambda: roll(F.stddev_pop, "close", N), S.roll("stddev_pop", "close", N))}
feature("t3_bollinger_width", [_MS, {"value": (lambda: div(4 * F.col("sd"), F.col("ma")) * 100, "4 * sd / nullif(ma, 0) * 100")}])
feature("t4_bollinger_percent", [_MS, {"value": (lambda: div(F.col("close") - (F.col("ma") - 2 * F.col("sd")), 4 * F.col("sd")), "(close - (ma - 2 * sd)) / nullif(4 * sd, 0)")}])
feature("t5_keltner_width", [_TP, {"kh": (lambda: (4 * F.col("high") - 2 * F.col("low") + F.col("close")) / 3, "(4 * high - 2 * low + close) / 3"), "kl": (lambda: (-2 * F.col("high") + 4 * F.col("low") + F.col("close")) / 3, "(-2 * high + 4 * low + close) / 3")}, {"value": (lambda: 100 * div(sma("kh", N) - sma("kl", N), sma("tp", N)), f"100 * ({S.roll('avg', 'kh', N)} - {S.roll('avg', 'kl', N)}) / nullif({S.roll('avg', 'tp', N)}, 0)")}])
_HL = {"hh": (lambda: roll(F.max, "high", N), S.roll("max", "high", N)), "ll": (lambda: roll(F.min, "low", N), S.roll("min", "low", N))}
feature("t6_donchian_width", [_HL, {"value": (lambda: 100 * div(F.col("hh") - F.col("ll"), sma("close", N)), f"100 * (hh - ll) / nullif({S.roll('avg', 'close', N)}, 0)")}])
feature("t7_donchian_percent", [_HL, {"value": (lambda: div(F.col("close") - F.col("ll"), F.col("hh") - F.col("ll")), "(close - ll) / nullif(hh - ll, 0)")}])
feature("t8_ulcer_index", [{"mx": (lambda: F.max("close").over(w(14)), "max(close) over w14")}, {"dd": (lambda: F.pow(100 * (F.col("close") - F.col("mx")) / F.col("mx"), 2), "power(100 * (close - mx) / mx, 2)")}, {"value": (lambda: F.sqrt(sma("dd", 14)), f"sqrt({S.roll('avg', 'dd', 14)})")}])
feature("t9_vortex_difference", [{"tr": (lambda: W.true_range(), atr_steps()[0]["tr"][1]), "vp": (lambda: F.abs(F.col("high") - lag("low")), "abs(high - lag(low) over o)"), "vm": (lambda: F.abs(F.col("low") - lag("high")), "abs(low - lag(high) over o)")}, {"value": (lambda: div(roll(F.sum, "vp", 14) - roll(F.sum, "vm", 14), roll(F.sum, "tr", 14)), f"({S.roll('sum', 'vp', 14)} - {S.roll('sum', 'vm', 14)}) / nullif({S.roll('sum', 'tr', 14)}, 0)")}])
_ROCS = {f"k{i}": (lambda r=r: F.col("close") / lag("close", r) - 1, f"close / lag(close, {r}) over o - 1") for i, r in enumerate((10, 15, 20, 30), 1)}
_KST = [_ROCS, {"kst": (lambda: 100 * (sma("k1", 10) + 2 * sma("k2", 10) + 3 * sma("k3", 10) + 4 * sma("k4", 15)), f"100 * ({S.roll('avg', 'k1', 10)} + 2 * {S.roll('avg', 'k2', 10)} + 3 * {S.roll('avg', 'k3', 10)} + 4 * {S.roll('avg', 'k4', 15)})")}]
feature("t11_kst", _KST)
feature("t12_kst_signal", [*_KST, {"value": (lambda: sma("kst", 9), S.roll("avg", "kst", 9))}])
feature("t13_kst_difference", [*_KST, {"sig": (lambda: sma("kst", 9), S.roll("avg", "kst", 9))}, {"value": (lambda: F.col("kst") - F.col("sig"), "kst - sig")}])


def _aroon(f, x: str) -> Column:
    return 100 * (25 - (F.col("bar_id") - gate(f("bar_id", x).over(w(26)), x, 26))) / 25


_AROON = {"au": (lambda: _aroon(lambda b, x: F.max_by(b, F.struct(x, b)), "high"), "100 * (25 - (bar_id - " + S.gate(26, "arg_max(bar_id, {'a': high, 'b': bar_id}) over w26", "high") + ")) / 25"), "ad": (lambda: _aroon(lambda b, x: F.max_by(b, F.struct((-F.col(x)).alias("x"), F.col(b))), "low"), "100 * (25 - (bar_id - " + S.gate(26, "arg_max(bar_id, {'a': -low, 'b': bar_id}) over w26", "low") + ")) / 25")}
_AROON = {k: (v[0], v[1].replace("/ 25", "/ 25.0::double")) for k, v in _AROON.items()}
feature("t18_aroon_up", [{"au": _AROON["au"]}])
feature("t19_aroon_down", [{"ad": _AROON["ad"]}])
feature("t20_aroon", [_AROON, {"value": (lambda: F.col("au") - F.col("ad"), "au - ad")}])
_BP = {"bp": (lambda: F.col("close") - F.least("low", lag("close")), "close - least(low, lag(close) over o)"), "rg": (lambda: F.greatest("high", lag("close")) - F.least("low", lag("close")), "greatest(high, lag(close) over o) - least(low, lag(close) over o)")}
feature("t25_ultimate", [_BP, {f"u{n}": (lambda n=n: div(roll(F.sum, "bp", n), roll(F.sum, "rg", n)), f"{S.roll('sum', 'bp', n)} / nullif({S.roll('sum', 'rg', n)}, 0)") for n in (7, 14, 28)}, {"value": (lambda: 100 * (4 * F.col("u7") + 2 * F.col("u14") + F.col("u28")) / 7, "100 * (4 * u7 + 2 * u14 + u28) / 7")}])
_ST = [{"hh": (lambda: roll(F.max, "high", 14), S.roll("max", "high", 14)), "ll": (lambda: roll(F.min, "low", 14), S.roll("min", "low", 14))}, {"k": (lambda: 100 * div(F.col("close") - F.col("ll"), F.col("hh") - F.col("ll")), "100 * (close - ll) / nullif(hh - ll, 0)")}]
feature("t26_stochastic", _ST)
feature("t27_stochastic_signal", [*_ST, {"value": (lambda: sma("k", 3), S.roll("avg", "k", 3))}])
feature("t28_williams_percent", [*_ST[:1], {"value": (lambda: -100 * div(F.col("hh") - F.col("close"), F.col("hh") - F.col("ll")), "-100 * (hh - close) / nullif(hh - ll, 0)")}])
