"""Frames over a symbol's bars and the rolling expressions made of them. All are columns; one sort by (symbol, bar_id) serves them all."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def order() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("bar_id")


def w(n: int) -> WindowSpec:
    """The last n rows, this one included."""
    return order().rowsBetween(1 - n, 0)


def between(a: int, b: int) -> WindowSpec:
    return order().rowsBetween(a, b)


def prefix() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def gate(value: Column, x: str | Column, n: int, spec: WindowSpec | None = None, least: int | None = None) -> Column:
    """value where the frame holds `least` (all n by default) values of x that are not null."""
    return F.when(F.count(col(x)).over(spec or w(n)) >= (n if least is None else least), value)


def sma(x: str | Column, n: int, least: int | None = None) -> Column:
    return gate(F.avg(col(x)).over(w(n)), x, n, least=least)


def roll(f, x: str | Column, n: int) -> Column:
    """Any aggregate f of x over the last n rows, gated."""
    return gate(f(col(x)).over(w(n)), x, n)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(order())


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def zscore(x: str | Column, n: int) -> Column:
    return div(col(x) - sma(x, n), roll(F.stddev_samp, x, n))


def bollinger(close: str | Column, n: int, use_log: bool = True) -> Column:
    x = F.ln(col(close)) if use_log else col(close)
    return zscore(x, n)


def rsi(close: str | Column, n: int) -> Column:
    """Gains over gains and losses of log returns, in 0..1."""
    r = F.ln(col(close) / lag(close))
    gain, loss = F.greatest(r, F.lit(0.0)), F.greatest(-r, F.lit(0.0))
    g, b = F.sum(gain).over(w(n)), F.sum(loss).over(w(n))
    return gate(div(g, g + b), r, n)


def true_range(high="high", low="low", close="close") -> Column:
    prev = lag(close)
    return F.when(prev.isNotNull(), F.greatest(col(high) - col(low), F.abs(col(high) - prev), F.abs(col(low) - prev)))


def atr(n: int = 30, window: int = 1) -> Column:
    """Mean true range; the previous close is `window` bars back and highs and lows are those of the last `window` bars."""
    h, lo, c = roll(F.max, "high", window), roll(F.min, "low", window), lag("close", window)
    tr = F.when(c.isNotNull(), F.greatest(h - lo, F.abs(h - c), F.abs(roll(F.max, "low", window) - c)))
    return sma(tr, n)


def vwap(n: int) -> Column:
    return div(F.sum(F.col("close") * F.col("volume")).over(w(n)), roll(F.sum, "volume", n))


def ffill(x: str | Column) -> Column:
    return F.last(col(x), ignorenulls=True).over(prefix())


def bfill(x: str | Column) -> Column:
    return F.first(col(x), ignorenulls=True).over(order().rowsBetween(0, Window.unboundedFollowing))


def fractional_weights(d: float, least: float) -> list[float]:
    """Binomial weights of (1 - L)^d, oldest last, until one is at most least in size."""
    out = [1.0]
    while abs(nxt := -out[-1] * (d - len(out) + 1) / len(out)) > least:
        out.append(nxt)
    return out


def fractional_difference(x: str | Column, d: float, least: float = 1e-2) -> Column:
    """The fixed-width fractional difference: a sum of lags, which Catalyst plans as one window."""
    weights = fractional_weights(d, least)
    return sum((F.lit(v) * lag(x, k) for k, v in enumerate(weights) if k), F.lit(weights[0]) * col(x))
