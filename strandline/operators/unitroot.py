"""Unit-root and explosiveness statistics of paths: regressions of many short paths at once, in Arrow batches of arrays of equal length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("symbol", "i0")


def design(y: np.ndarray, constant: str = "c", lags: int = 1, level: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Paths (m x n) -> changes (m x r) and regressors (m x r x k): the level before, the changes 1..lags before, and by `constant` (nc, c, ct, ctt) one, trend, trend squared."""
    d = np.diff(y, axis=1)
    r = d.shape[1] - lags
    if r < 1:
        return np.zeros((len(y), 0)), np.zeros((len(y), 0, lags + level + ("nc", "c", "ct", "ctt").index(constant)))
    cols = ([y[:, -r - 1 : -1]] if level else []) + [d[:, lags - k : d.shape[1] - k] for k in range(1, lags + 1)]
    trend = np.broadcast_to(np.arange(r, dtype=float), (len(y), r))
    cols += [trend**k for k in range(("nc", "c", "ct", "ctt").index(constant))]
    return d[:, lags:], np.stack(cols, axis=2)


def t_values(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The t value of the first coefficient of each regression; nan where there are too few rows or none is defined."""
    m, r, k = x.shape
    out = np.full(m, np.nan)
    ok = np.isfinite(y).all(axis=1) & np.isfinite(x).all(axis=(1, 2))
    if r <= k or not ok.any():
        return out
    y, x = y[ok], x[ok]
    # Columns to unit length first, so that the inverse is well conditioned.
    scale = np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale[scale == 0] = 1
    x = x / scale
    inv = np.linalg.pinv(np.einsum("mri,mrj->mij", x, x), rcond=1e-13, hermitian=True)
    b = np.einsum("mij,mj->mi", inv, np.einsum("mri,mr->mi", x, y))
    err = y - np.einsum("mri,mi->mr", x, b)
    var = (err * err).sum(axis=1) / (r - k) * inv[:, 0, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        out[ok] = np.where(var > 0, b[:, 0] / np.sqrt(var), np.nan)
    return out


def adf(y: np.ndarray, constant: str = "c", lags: int = 1) -> np.ndarray:
    return t_values(*design(y, constant, lags))


def _over_starts(y: np.ndarray, x: np.ndarray, starts: range, quantile: float | None, size: Callable = lambda v: v) -> np.ndarray:
    got = [size(t_values(y[:, s:], x[:, s:])) for s in starts if y.shape[1] - s > x.shape[2]]
    if not got:
        return np.full(len(y), np.nan)
    all_ = np.stack(got)
    none = np.isnan(all_).all(axis=0)
    all_[:, none] = 0.0
    out = np.nanmax(all_, axis=0) if quantile is None else np.nanquantile(all_, quantile, axis=0)
    return np.where(none, np.nan, out)


def backward_sup_adf(y: np.ndarray, least: int, constant: str = "c", lags: int = 1, quantile: float | None = None) -> np.ndarray:
    """The greatest (or a quantile) of the ADF t values over all starts that leave at least `least` points."""
    d, x = design(y, constant, lags)
    return _over_starts(d, x, range(d.shape[1] + lags - least + 1), quantile)


def martingale_test(y: np.ndarray, kind: str, least: int, quantile: float | None = None) -> np.ndarray:
    """Sub- and super-martingale test: |t| of the leading term of poly1 (on y), poly2, exp or power (on ln y) over all starts that leave `least` points."""
    n = y.shape[1]
    trend, one = np.arange(n, dtype=float), np.ones(n)
    cols = {"poly1": [trend**2, trend, one], "poly2": [trend**2, trend, one], "exp": [trend, one], "power": [np.log(trend + 1), one]}[kind]
    x = np.broadcast_to(np.stack(cols, axis=1), (len(y), n, len(cols)))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = y if kind == "poly1" else np.log(y)
    return _over_starts(z, x, range(n - least + 1), quantile, np.abs)


def recursive_cusum(y: np.ndarray, lags: int = 1, constant: str = "c") -> np.ndarray:
    """The sum of the standardised recursive residuals of the changes on their lags: each row is forecast from those before it."""
    d, x = design(y, constant, lags, level=False)
    m, r, k = x.shape
    out = np.where(np.isfinite(y).all(axis=1), 0.0, np.nan)
    for t in range(k, r):
        a = x[:, :t]
        inv = np.linalg.pinv(np.einsum("mri,mrj->mij", np.nan_to_num(a), np.nan_to_num(a)), rcond=1e-13, hermitian=True)
        b = np.einsum("mij,mj->mi", inv, np.einsum("mri,mr->mi", a, d[:, :t]))
        error = d[:, t] - (x[:, t] * b).sum(axis=1)
        out = out + error / np.sqrt(1 + np.einsum("mi,mij,mj->m", x[:, t], inv, x[:, t]))
    return out


def over_paths(p: DataFrame, f: Callable[[np.ndarray], np.ndarray], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """paths(keys, step, value) -> keys, value: f of all paths of one length at a time (m x n in, m out). A path with a missing value has none."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        out = np.full(len(values), np.nan)
        sizes = values.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.nonzero(sizes == n)[0]
            out[at] = f(np.stack([np.asarray(values.iloc[i], float) for i in at]))
        return pd.Series(out)

    whole = p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("x"), (F.count("value") == F.count(F.lit(1))).alias("ok"))
    return whole.where("ok").select(*keys, F.nanvl(run(F.transform("x", lambda s: s["value"])), F.lit(None)).alias("value"))


def two_regressors(y: str, a: str, b: str) -> dict:
    """Aggregates of y on a and b with intercept: t value of a, from sums alone, so a series of any length needs no path."""
    ok = F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    n = F.count(F.when(ok, 1))
    s = lambda u, v: F.covar_pop(F.when(ok, F.col(u)), F.when(ok, F.col(v))) * n
    det = s(a, a) * s(b, b) - s(a, b) * s(a, b)
    first = F.try_divide(s(b, b) * s(a, y) - s(a, b) * s(b, y), det)
    second = F.try_divide(s(a, a) * s(b, y) - s(a, b) * s(a, y), det)
    rss = F.greatest(s(y, y) - first * s(a, y) - second * s(b, y), F.lit(0.0))
    return {"t": F.when(n > 3, F.try_divide(first, F.sqrt(F.try_divide(rss / (n - 3) * s(b, b), det)))), "n": n}
