"""Zipped archives with and without headers, CSV with both kinds of time, dated folders, pages of a venue."""

import datetime as dt
import zipfile

import pandas as pd
import pytest

from strandline.operators import markets as M
from strandline.sources import files as S


def test_zips(spark, tmp_path):
    head = ",".join(S.TRADES)
    texts = {"a.zip": f"{head}\n1,10.5,2,21,1700000000000,true\n2,11,1,11,1700000001000,false\n", "b.zip": "3,1.2.3,2,2.4,1700000002000,False\n4,2,2,4,1700000003000,true\n"}
    for name, text in texts.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("inner.csv", text)
    (tmp_path / "c.zip").write_text(f"{head}\n5,3,1,3,1700000004000,true\n")
    (tmp_path / "d.zip").write_bytes(b"PK\x03\x04broken\0\0")
    df = S.read_zips(spark, f"file://{tmp_path}", S.TRADES, {"id": "id", "price": "price", "time": "Time", "is_buyer_maker": "maker"}, {"id": "long", "time": "ms", "is_buyer_maker": "boolean"})
    got = {(r["id"], r["price"], r["maker"]) for r in df.collect()}
    assert got == {(1, 10.5, True), (2, 11.0, False), (3, 1.23, False), (4, 2.0, True), (5, 3.0, True)}
    assert df.agg({"Time": "min"}).first()[0] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_lines_of_another_length_are_told(spark, tmp_path):
    (tmp_path / "a.zip").write_text(",".join(S.TRADES) + '\n1,"10.5",2,21,1700000000000,true\n\n2,11,1\n3,"1,5",2,3,1700000000000,true\n4,1,2,3,1700000000000,true,x\n')
    ask = lambda **x: S.read_zips(spark, f"file://{tmp_path}", S.TRADES, {"id": "id", "price": "price"}, {"id": "long"}, **x)
    assert {tuple(r) for r in ask(bad="odd").collect()} == {(1, 10.5, None), (None, None, "2,11,1"), (3, None, None), (None, None, "4,1,2,3,1700000000000,true,x")}
    with pytest.raises(Exception, match="a.zip, line 4: 3 cells in place of 6"):
        ask().count()


def test_csv_and_sink(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Time,Close\n1700000000000,1.5\n2023-11-14 22:13:21,2\n,3\n")
    got = [tuple(r) for r in S.read_csv(spark, f"file://{tmp_path}/x.csv").collect()]
    assert got == [(dt.datetime(2023, 11, 14, 22, 13, 20), 1.5), (dt.datetime(2023, 11, 14, 22, 13, 21), 2.0), (None, 3.0)]
    S.write_csv(spark.range(3), f"file://{tmp_path}/out")
    S.write_csv(spark.range(9), f"file://{tmp_path}/out")  # left as it is
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).count() == 3


def test_dated_folders_are_pruned(spark, tmp_path):
    rows = [(s, dt.datetime(2024, 1, d), float(d)) for s in "ab" for d in range(1, 6)]
    path = f"file://{tmp_path}/dates"
    S.write_dates(spark.createDataFrame(rows, "symbol string, time timestamp_ntz, close double"), path)
    df = S.read_dates(spark, path, ["a"], "2024-01-02", "2024-01-03")
    assert df.agg({"close": "sum"}).first()[0] == 5.0
    assert "PartitionFilters: [isnotnull" in df._jdf.queryExecution().toString()


def test_pages_of_a_venue(spark):
    p = S.pages(spark, ["x", "y"], "2024-01-01 00:00:00", "2024-01-02 00:00:00", 5, 200)
    assert p.count() == 4 and p.where("last > first").count() == 4

    def fetch(page):
        if page["symbol"] == "y":
            return None
        times = pd.date_range(page["first"], page["last"], freq="5min", inclusive="left")
        return pd.DataFrame({"symbol": page["symbol"], "time": times, "close": 1.0})

    got = S.fetched(p, fetch, "symbol string, time timestamp_ntz, close double", 2)
    assert got.count() == got.distinct().count() == 288


def test_repaired(spark):
    cells = ["1.2.3", "7", "1.5", "a.b.c.d", "", None]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(M.repaired("c")).collect()
    assert [r[0] for r in got] == ["1.23", "7", "1.5", "a.bcd", "", None]
