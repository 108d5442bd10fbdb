"""Measures of a series of returns, as aggregate columns. Zero days are left out where the name says so by `nonzero`."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .windows import col, div


def nonzero(r: str | Column) -> Column:
    return F.when(col(r) != 0, col(r))


def zscore(r: str | Column, mean: float = 0.0) -> Column:
    x = nonzero(r)
    return div(F.avg(x) - mean, F.stddev_samp(x)) * F.sqrt(F.count(x).cast("double"))


def sharpe(r: str | Column, days: Column) -> Column:
    return div(F.avg(col(r)), div(F.stddev_samp(col(r)), F.sqrt(F.count(col(r)) * 365.0 / days)))


def sharpe_zero(r: str | Column, days: Column, annualized: bool = False) -> Column:
    """Sum over root of squares; divided by the annual factor as published, or multiplied by it."""
    raw, factor = div(F.sum(col(r)), F.sqrt(F.sum(col(r) * col(r)))), F.sqrt(F.count(col(r)) * 365.0 / days)
    return raw * factor if annualized else div(raw, factor)


def kelly(r: str | Column) -> Column:
    """Of log returns; -1 without gains, 1 without losses."""
    x = F.exp(col(r)) - 1
    win = F.avg(F.when(x > 0, 1.0).otherwise(0.0))
    gain, loss = F.avg(F.when(x > 0, x)), -F.avg(F.when(x < 0, x))
    return F.when(gain.isNull(), -1.0).when(loss.isNull(), 1.0).otherwise(win - div((1 - win) * loss, gain))


def profit_factor(daily: str | Column) -> Column:
    return div(F.sum(F.when(col(daily) > 0, col(daily))), -F.sum(F.when(col(daily) < 0, col(daily))))


def utility(daily: str | Column, data_days: float, trading_days: float = 365.0) -> dict[str, Column]:
    """Sharpe, utility and yearly return of daily sums."""
    r = F.sum(col(daily))
    s = div(r, F.sqrt(F.sum(col(daily) * col(daily)))) * (trading_days / data_days) ** 0.5
    return {"sharpe": s, "utility": r * F.greatest(F.lit(0.0), F.least(F.lit(6.0), s)) * (trading_days / data_days), "annual": r * (trading_days / data_days)}


#: Degrees of freedom from which Student's t is taken for the normal deviate of equal tail.
NEAR_NORMAL = 1000


def normal_tail(z: Column, steps: int = 400, width: float = 10.0) -> Column:
    """P(Z > z) of a normal deviate: Simpson's rule over the `width` deviations beyond |z|, as one column."""
    a, h = F.abs(z), width / steps
    f = lambda k: F.exp(-(a + k * h) * (a + k * h) / 2)
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 4.0).otherwise(2.0) * f(k))
    tail = h / 3 * (f(F.lit(0)) + inner + f(F.lit(steps))) / math.sqrt(2 * math.pi)
    return F.when(z < 0, 1 - tail).otherwise(tail)


def student_tail(t: Column, df: Column, steps: int = 400) -> Column:
    """P(T > t) of Student's t: Simpson's rule over the angle, atan(t / sqrt(df)) = a, of cos(a)**(df - 1), all as one column.

    From NEAR_NORMAL degrees of freedom on that peak is narrower than the steps, so t becomes a normal deviate, (8n + 1) / (8n + 3) *
    sqrt(n ln(1 + t^2 / n)), which is off by less than 1e-6 there.
    """
    n = df.cast("double")
    whole, upper = F.lit(math.pi / 2), F.atan(t / F.sqrt(n))

    def area(a: Column) -> Column:
        f = lambda k: F.pow(F.cos(a * k / steps), n - 1)
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 4.0).otherwise(2.0) * f(k))
        return a / steps / 3 * (f(F.lit(0)) + inner + f(F.lit(steps)))

    z = F.signum(t) * (8 * n + 1) / (8 * n + 3) * F.sqrt(n * F.log1p(t * t / n))
    return F.when(n >= NEAR_NORMAL, normal_tail(z)).otherwise(0.5 - area(upper) / area(whole) / 2)
