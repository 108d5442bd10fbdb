"""Operators that SQL can't say, against plain versions on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.metrics import student_tail
from strandline.operators import encodings as E
from strandline.operators import levels as V
from strandline.operators.events import cusum_events, non_overlapping, sum_exits
from strandline.operators.paths import last_rows


@pytest.mark.parametrize("block", [3, 4096])
def test_greedy_walk(spark, block):
    r = random.Random(block)
    rows = [(s, i, i + r.choice((0, 1, 2, 5, 9))) for s in "ab" for i in sorted(r.sample(range(300), 80))]
    want = set()
    for s in "ab":
        end = -1
        for _, i, j in (x for x in rows if x[0] == s):
            if i >= end:
                want.add((s, i, j))
                end = j
    got = non_overlapping(spark.createDataFrame(rows, "symbol string, i0 long, i1 long"), "i0", "i1", block=block)
    assert {tuple(x) for x in got.collect()} == want
    assert non_overlapping(spark.createDataFrame([], "symbol string, i0 long, i1 long"), "i0", "i1").count() == 0


def plain_match_entropy(msg):
    m, total, points = msg[::-1], 0.0, range(1, len(msg) // 2 + 1)
    for i in points:
        found = ""
        for k in range(i):
            part = m[i : i + k + 1]
            if any(m[j : j + k + 1] == part for j in range(i - i, i)):
                found = part
        total += math.log2(i + 1) / (len(found) + 1)
    return total / len(points)


def test_match_entropy(spark):
    r = random.Random(2)
    for n in (2, 3, 8, 20, 31):
        for _ in range(20):
            msg = "".join(r.choice("01") for _ in range(n))
            assert E.match_entropy(msg) == pytest.approx(plain_match_entropy(msg))
    assert E.match_entropy("0" * 20) < E.match_entropy("01101000111010010110") and E.match_entropy("01" * 9, 3) is not None
    got = spark.createDataFrame([("0110",), (None,)], "m string").select(E.match_entropy_of()("m")).collect()
    assert got[0][0] == pytest.approx(plain_match_entropy("0110")) and got[1][0] is None


def test_two_factor(spark):
    r = random.Random(3)
    rows = [("a", i, 100 * math.exp(r.gauss(0, 0.3)), 0.2) for i in sorted(r.sample(range(200), 60))]
    gone = [False] * len(rows)
    for j in range(len(rows)):
        if gone[j]:
            continue
        for k in range(j + 1, len(rows)):
            if rows[k][1] - rows[j][1] >= 8 or math.log(rows[k][2] / rows[j][2]) <= -2 * 0.2:
                break
            gone[k] = True
    got = E.two_factor(spark.createDataFrame(rows, "symbol string, i0 long, p0 double, vol double"), 8, 2.0)
    assert {x["i0"] for x in got.collect()} == {x[1] for x, g in zip(rows, gone) if not g}


def test_student_tail(spark):
    # Table values of the one-sided tail.
    table = [(0.0, 5, 0.5), (2.228139, 10, 0.025), (1.812461, 10, 0.05), (6.313752, 1, 0.05), (-1.812461, 10, 0.95), (2.042272, 30, 0.025)]
    got = spark.createDataFrame(table, "t double, df int, p double").select(student_tail(F.col("t"), F.col("df")).alias("q"), "p").collect()
    assert all(abs(r["q"] - r["p"]) < 1e-5 for r in got)
    for n in (999, 1000, 10**4, 10**6, 10**8):
        # The density's own sum, of steps fine enough for every n.
        for t in (-2.5, 0.0, 0.7, 1.96, 4.0):
            x = np.linspace(t, t + 40, 400_001)
            log = math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(n * math.pi) if n < 10**5 else -0.5 * math.log(2 * math.pi)
            want = float(np.trapezoid(np.exp(log - (n + 1) / 2 * np.log1p(x * x / n)), x))
            q = spark.createDataFrame([(t, n)], "t double, df long").select(student_tail(F.col("t"), F.col("df"))).first()[0]
            assert abs(q - want) < 2e-6


def test_levels(spark):
    assert V.level_bins([1.0, 1.2, 1.6, 2.5, 2.6], 2) == [pytest.approx(1.1), 1.6]
    assert V.level_bins([], 2) == [8.0, 8.0] and V.level_bins([1.0, 1.1], 2) == [8.0, 8.0]
    y = np.array([0, 3, 1, 2, 0, 5, 5, 5, 1.0])
    assert V.prominent(y, 0.5).tolist() == [1, 3, 6] and V.prominent(y, 2.5).tolist() == [1, 6] and V.prominent(y, 6).tolist() == []
    rows = [("a", 1, k, float(v)) for k, v in enumerate([2, 0, 4, 1, 3])]
    got = V.between_levels(spark.createDataFrame(rows, "symbol string, i0 long, step int, value double"), 0.5).first()
    assert got["value"] == pytest.approx(0.75)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_cusum_resets(spark, block):
    r = random.Random(5)
    rows, want = [], set()
    for s in "ab":
        x, v = [], 0.0
        for _ in range(150):
            v += r.gauss(0, 1)
            x.append(None if r.random() < 0.05 else v)
        rows += [(s, i, i, v, 1.5 if i % 10 else None) for i, v in enumerate(x)]
        hi = lo = 0.0
        for i in range(1, len(x)):
            # A null sets both sums to nothing, at its own bar and at the next.
            hi, lo = (0.0, 0.0) if None in (x[i], x[i - 1]) else (max(0.0, hi + x[i] - x[i - 1]), min(0.0, lo + x[i] - x[i - 1]))
            if i % 10 and lo < -1.5:
                want.add((s, i, -1))
                lo = 0.0
            if i % 10 and hi > 1.5:
                want.add((s, i, 1))
                hi = 0.0
    df = spark.createDataFrame(rows, "symbol string, time long, bar_id long, x double, h double").repartition(3)
    got = cusum_events(df, "x", "h", block=block).collect()
    assert len(got) == len(want) and {(g["symbol"], g["bar_id"], g["side"]) for g in got} == want
    assert {g["side"] for g in cusum_events(df, "x", "h", use_neg=False, block=block).collect()} == {1}


def test_sum_exits():
    """The map of a block against a walk from many entries."""
    r = random.Random(1)
    for _ in range(300):
        n = r.randrange(1, 30)
        steps, limits = [r.gauss(0, 1) if r.random() > 0.03 else math.nan for _ in range(n)], [r.choice((0.8, 2.0, math.nan)) for _ in range(n)]
        tops, leave, kept = sum_exits(np.array(steps), np.array(limits))
        assert tops == sorted(tops) and tops[-1] == math.inf
        for entry in [0.0, *(r.random() * 6 for _ in range(20))]:
            s = entry
            for d, h in zip(steps, limits):
                s = max(0.0, s + d)
                s = 0.0 if s > h else s
            k = int(np.searchsorted(tops, entry))
            assert leave[k] + (entry if kept[k] else 0.0) == pytest.approx(s, abs=1e-12)


@pytest.mark.parametrize(("block", "splits"), [(1, 4), (7, 16), (4096, 256)])
def test_quantile_messages(spark, block, splits):
    r = random.Random(4)
    series = {s: [None if r.random() < 0.1 else float(r.choice((r.randrange(5), r.gauss(0, 3)))) for _ in range(70)] for s in "ab"}
    bars = spark.createDataFrame([(s, i, x) for s, v in series.items() for i, x in enumerate(v)], "symbol string, bar_id long, x double").repartition(3)
    ranked = {(x["symbol"], x["bar_id"]): (x["rank"], x["n"]) for x in E.prefix_ranks(bars.where("x is not null"), "x", block=block, splits=splits).collect()}
    for s, v in series.items():
        for i, x in enumerate(v):
            so_far = [y for y in v[: i + 1] if y is not None]
            assert x is None or ranked[s, i] == (sum(y <= x for y in so_far), len(so_far))
    events = bars.where("bar_id % 3 = 0").selectExpr("symbol", "bar_id as i0")
    got = {(x["symbol"], x["i0"]): x["msg"] for x in E.quantile_messages(events, bars, "x", 12, 4, block=block).collect()}
    for s, v in series.items():
        for i in range(0, 70, 3):
            so_far, near = ([y for y in z if y is not None] for z in (v[: i + 1], v[max(0, i - 11) : i + 1]))
            edges = np.quantile(so_far, [0.25, 0.5, 0.75]) if so_far else []
            assert got.get((s, i)) == ("".join(str(int(sum(q <= x + 1e-12 for q in edges))) for x in near) if near else None)


def test_level_ratio(spark):
    """Pivots walked back one by one: those over half a deviation that set a new extreme, in greedy bins."""
    r = random.Random(6)
    closes = [100 + 6 * math.sin(i / 3) + r.gauss(0, 2) for i in range(160)]
    bars = spark.createDataFrame([("a", i, c) for i, c in enumerate(closes)], "symbol string, bar_id long, close double")
    at = list(range(60, 160, 7))
    events = spark.createDataFrame([("a", i, closes[i]) for i in at], "symbol string, i0 long, p0 double")
    deviations = spark.createDataFrame([("a", i, 0.01 + i / 10_000) for i in at], "symbol string, i0 long, value double")
    got = {x["i0"]: x["value"] for x in V.level_ratio(events, bars, deviations, 50, 3).collect()}
    for i in at:
        up, down = [], []
        for k in range(i - 3, i - 51, -1):
            near = closes[k - 3 : k] + closes[k + 1 : k + 4]
            if k >= 3 and (max(near) <= closes[k] or min(near) >= closes[k]):
                z = math.log(closes[k] / closes[i]) / (0.01 + i / 10_000)
                if z > 0.5 and z >= max(up, default=z):
                    up.append(z)
                if z < -0.5 and z <= min(down, default=z):
                    down.append(z)

        def bins(levels):
            out, held = [], []
            for z in levels:
                if held and abs(z - held[0]) > 0.5:
                    out.append(sum(held) / len(held))
                    held = []
                held.append(z)
            return [*out, 8.0, 8.0][:2]

        assert got[i] == pytest.approx(abs(sum(bins(up)) / sum(bins(down))))


def test_redundancy(spark):
    df = spark.createDataFrame([("0110100110010110", 0.9), ("1", 0.5), (None, None)], "m string, h double")
    got = [x[0] for x in df.select(E.redundancy(F.col("h"), F.col("m"))).collect()]
    assert got[0] == pytest.approx(1 - 0.9 / 4) and got[1:] == [None, None]


@pytest.mark.parametrize("block", ["1 second", "2 hours", "90 days"])
def test_last_rows(spark, block):
    import datetime as dt

    r = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(minutes=r.randrange(900))
    rows = [(r.choice("ab"), at(), i, float(i)) for i in range(300)]
    events = [(r.choice("abc"), at(), k) for k in range(60)]
    got = last_rows(spark.createDataFrame(events, "symbol string, time timestamp_ntz, k long"), spark.createDataFrame(rows, "symbol string, time timestamp_ntz, id long, x double"), 4, block=block)
    want = set()
    for s, t, k in events:
        before = sorted((y, i) for x, y, i, _ in rows if x == s and y < t)
        want |= {(k, p, i) for p, (_, i) in enumerate(reversed(before[-4:]), 1)}
    found = [(x["k"], x["place"], x["id"]) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
