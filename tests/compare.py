"""Whether a query's rows are those of its SQL: columns by name, rows in any order, floats to nine digits."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def _cell(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, pd.Timestamp):
        return x.tz_localize(None)
    if hasattr(x, "item"):
        return _cell(x.item())
    if type(x).__name__ == "Decimal":
        return _cell(float(x))
    if isinstance(x, int):
        return float(f"{x:.9g}") if abs(x) < 10**9 else x
    return x if isinstance(x, str) else tuple(map(_cell, x)) if isinstance(x, (list, tuple)) else x


def rows(pdf: pd.DataFrame) -> Counter:
    pdf = pdf[sorted(pdf.columns)]
    return Counter(tuple(map(_cell, r)) for r in pdf.itertuples(index=False, name=None))


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if they are equal."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} instead of {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    return f"{sum(a.values())} rows instead of {sum(b.values())}; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
