"""Counts of signals for every threshold, against bar by bar; nulls, ties, distances."""

import random

import pytest

from strandline.operators.thresholds import find_threshold, signal_counts


def plain_count(values, thr, distance):
    raw = [i > 0 and None not in (values[i], values[i - 1]) and values[i - 1] < thr <= values[i] for i in range(len(values))]
    return sum(r and i >= distance and not any(raw[max(0, i - distance) : i]) for i, r in enumerate(raw))


@pytest.mark.parametrize("distance", [0, 1, 3, 6])
def test_counts(spark, distance):
    r = random.Random(distance)
    series = {s: [None if r.random() < 0.1 else float(r.randrange(12)) for _ in range(90)] for s in "abc"}
    bars = spark.createDataFrame([(s, i, x) for s, v in series.items() for i, x in enumerate(v)], "symbol string, bar_id long, x double")
    got = {(x["symbol"], x["threshold"]): x["signals"] for x in signal_counts(bars, "x", distance).collect()}
    assert got == {(s, t): plain_count(v, t, distance) for s, v in series.items() for t in set(v) - {None}}
    for s, v in series.items():
        assert plain_count(v, 4.5, distance) == got[s, min(x for x in v if x is not None and x >= 4.5)]


@pytest.mark.parametrize("lower", [False, True])
def test_search(spark, lower):
    r = random.Random(5)
    rows, series = [], {}
    for s in "ab":
        x, series[s] = 0.0, []
        for i in range(800):
            x = 0.8 * x + r.gauss(0, 1)
            series[s].append(round(x, 3))
            rows.append((s, i, round(x, 3)))
    bars = spark.createDataFrame(rows, "symbol string, bar_id long, x double").selectExpr("*", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(3 * bar_id as int), 0, 0) as time")
    for row in find_threshold(bars, "x", 9, lower).collect():
        v = [-x if lower else x for x in series[row["symbol"]]]
        middle = sorted(v)[399:401]
        target = (3 * 799 // 24) / 30 * 9
        off = {t: abs(plain_count(v, t, 3) - target) for t in set(v) if t >= sum(middle) / 2}
        best = min(off, key=lambda t: (round(off[t], 9), t))
        assert (row["threshold"], row["signals"]) == (-best if lower else best, plain_count(v, best, 3)) and row["target"] == pytest.approx(target)


def test_empty(spark):
    assert find_threshold(spark.createDataFrame([], "symbol string, bar_id long, x double, time timestamp_ntz"), "x", 5).count() == 0
