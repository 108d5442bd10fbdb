"""Stateful streams with disordered and late input, over several batches, against the same steps in order."""

import datetime as dt
import random

import pytest

from strandline.streaming import ordered as O

START = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, rows, schema, files=5):
    """Rows shuffled over a few places, so that neighbours are in other files; one a batch."""
    r = random.Random(2)
    rows = sorted(rows, key=lambda x: x[1] + dt.timedelta(seconds=r.uniform(0, 400)))
    n = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * n : k * n + n], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(df, spark, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return [tuple(r) for r in spark.table(name).collect()]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before[1])


def test_bars_in_order_across_batches(spark, tmp_path):
    r = random.Random(1)
    trades = [("ab"[i % 2], START + dt.timedelta(seconds=20 * i), 100.0 + r.randrange(30), float(r.randrange(1, 5))) for i in range(300)]
    end = trades[-1][1] - dt.timedelta(minutes=10)
    got = sorted(run(O.ordered_bars(feed(spark, tmp_path, trades, "symbol string, time timestamp, price double, qty double"), 7.0), spark, "ordered_bars", tmp_path))
    for s in "ab":
        flat = [p for x, t, p, q in trades if x == s and t <= end for _ in range(int(q))]
        want = [(s, k, 7.0, sum(flat[7 * k : 7 * k + 7]), flat[7 * k + 6]) for k in range(len(flat) // 7)]
        mine = [g for g in got if g[0] == s]
        assert len(want) - 1 <= len(mine) <= len(want) + 1 and mine[: len(want) - 1] == want[: len(want) - 1]


def test_monitor_with_a_refreshed_table(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for ticker in ("X", "Y", "Z"):
        rows += [(ticker, START + dt.timedelta(minutes=5 * k), round(r.uniform(-0.02, 0.1), 4), float(r.choice((100, 900))), None) for k in range(60)]
    rows += [("X", START - dt.timedelta(seconds=1), None, None, True), ("Y", START + dt.timedelta(minutes=99), None, None, True), ("X", START + dt.timedelta(minutes=152), None, None, False), ("X", START + dt.timedelta(minutes=201), None, None, True)]
    schema = "ticker string, time timestamp, premium double, dollars double, listed boolean"
    got = run(O.monitored(feed(spark, tmp_path, rows, schema), 0.03, 500.0), spark, "monitored", tmp_path)
    want, state = [], {}
    for ticker, t, p, d, flag in sorted(rows, key=lambda x: x[1]):
        listed, held = state.get(ticker, (False, []))
        if flag is not None:
            state[ticker] = (flag, held if flag else [])
        elif listed:
            held = [*held, p][-6:]
            state[ticker] = (listed, held)
            if len(held) == 6 and abs(sum(held) / 6) > 0.03 and d > 500:
                want.append((ticker, t, round(sum(held) / 6, 9), p, d))
    end = max(x[1] for x in rows) - dt.timedelta(minutes=10)
    got = sorted((a, b, round(c, 9), d, e) for a, b, c, d, e in got)
    assert [g for g in got if g[1] < end] == sorted(w for w in want if w[1] < end) and {g[0] for g in got} == {"X", "Y"}
