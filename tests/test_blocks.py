"""Tick rule, bars and as-of lookups give the same rows for every width of block, and those of a plain version."""

import random
from datetime import datetime, timedelta

import pytest

from strandline.operators.bars import tick_bars, tick_rule
from strandline.operators.paths import as_of

START = datetime(2024, 1, 1)


def trades(seed=1, n=400):
    r = random.Random(seed)
    rows, t = [], {"a": START, "b": START}
    for i in range(n):
        s = "a" if r.random() < 0.8 else "b"
        t[s] += timedelta(seconds=r.choice((0, 1, 40, 4000, 90_000)))
        rows.append((s, t[s], i, float(r.choice((10, 10, 11, 12))), r.choice((1, 2, 5, 30))))
    return rows


SCHEMA = "symbol string, time timestamp_ntz, id long, price double, qty long"


def plain_bars(rows, size):
    out = []
    for s in sorted({x[0] for x in rows}):
        bar, cum, up, last, held = 0, 0, None, None, {}
        for _, time, i, price, qty in sorted((x for x in rows if x[0] == s), key=lambda x: (x[1], x[2])):
            if last is not None and price != last:
                up = 1.0 if price > last else -1.0
            crossed, cum, rest = last is not None and (cum + qty) // size > cum // size, cum + qty, (cum + qty) % size
            last = price
            for part, b in [(qty - rest, bar), (rest, bar + 1)] if crossed and rest else [(qty, bar)]:
                held.setdefault(b, []).append((time, price, part, up))
            bar += crossed
        for b, x in held.items():
            if sum(p for _, _, p, _ in x) >= 0.999 * size:
                buy = sum(p for _, _, p, u in x if u == -1)
                out.append((s, b, x[0][0], x[-1][0], x[0][1], max(p for _, p, *_ in x), min(p for _, p, *_ in x), x[-1][1], float(sum(p for _, _, p, _ in x)), float(buy), sum(u is not None for *_, u in x)))
    return sorted(out)


@pytest.mark.parametrize("block", ["1 second", "7 hours", "30 days"])
@pytest.mark.parametrize("size", [7, 60])
def test_tick_bars(spark, block, size):
    rows = trades(size)
    got = tick_bars(spark.createDataFrame(rows, SCHEMA).repartition(5), size, block=block)
    got = got.select("symbol", "bar", "time0", "time1", "open", "high", "low", "close", "volume", "volume_buy", "tick").collect()
    assert [(*x[:8], round(x[8], 6), round(x[9], 6), x[10]) for x in sorted(got)] == plain_bars(rows, size)


@pytest.mark.parametrize("block", ["1 second", "5 hours", "400 days"])
def test_tick_rule(spark, block):
    rows = trades(3)
    want = {}
    for s in "ab":
        last = up = None
        for _, _, i, price, _ in sorted((x for x in rows if x[0] == s), key=lambda x: (x[1], x[2])):
            if last is not None and price != last:
                up = 1.0 if price > last else -1.0
            want[i], last = up, price
    assert {x["id"]: x["up"] for x in tick_rule(spark.createDataFrame(rows, SCHEMA).repartition(3), block).collect()} == want


@pytest.mark.parametrize("block", ["1 hour", "3 days", "900 days"])
@pytest.mark.parametrize(("strict", "forward"), [(False, False), (True, False), (False, True), (True, True)])
def test_as_of(spark, block, strict, forward):
    r = random.Random(9)
    at = lambda: START + timedelta(hours=r.randrange(900))
    left = [(r.choice("abc"), at(), k) for k in range(200)] + [("d", at(), 900), (None, at(), 901)]
    right = list({(s, t): (s, t, k) for k in range(120) for s, t in [(r.choice("abe"), at())]}.values())
    ok = {(False, False): lambda t, u: u <= t, (True, False): lambda t, u: u < t, (False, True): lambda t, u: u >= t, (True, True): lambda t, u: u > t}[strict, forward]
    want = {}
    for s, t, k in left:
        near = [(u, j) for x, u, j in right if x == s and ok(t, u)]
        want[k] = ((min if forward else max)(near) if near else (None, None))
    df = as_of(spark.createDataFrame(left, "symbol string, time timestamp_ntz, k long"), spark.createDataFrame(right, "symbol string, time timestamp_ntz, k long"), strict=strict, forward=forward, block=block)
    rows = df.collect()
    assert len(rows) == len(left) and {x["k"]: (x["time_r"], x["k_r"]) for x in rows} == want


def test_no_window_holds_a_symbol(spark):
    """Raw rows are windowed by symbol and block; a window by symbol alone is over the summaries of blocks, after an aggregate."""
    ticks = spark.createDataFrame(trades(), SCHEMA)
    plan = as_of(ticks, ticks.select("symbol", "time", "price"))._jdf.queryExecution().analyzed().toString()
    whole = [x for x in plan.splitlines() if "Window [" in x and "[symbol" in x and "_b" not in x.split("], [")[1]]
    assert all("_end" in x for x in whole)


@pytest.mark.parametrize("forward", [False, True])
def test_frames_begin_with_their_partition(spark, forward):
    """A frame that runs to its partition's end is gone through anew for each row, so it is quadratic in the rows of a block, and over the blocks of a symbol."""
    ticks = spark.createDataFrame(trades(), SCHEMA)
    plan = as_of(ticks, ticks.select("symbol", "time", "price"), forward=forward)._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("windowframe(") >= 2 and "unboundedpreceding" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("forward", [False, True])
def test_nulls_meet_nothing(spark, forward):
    rows = [(s, t, k) for k, (s, t) in enumerate((s, t) for s in ("a", None) for t in (START, None))]
    df = spark.createDataFrame(rows, "symbol string, time timestamp_ntz, k long")
    assert {x["k"]: x["k_r"] for x in as_of(df, df, forward=forward).collect()} == {0: 0, 1: None, 2: None, 3: None}
