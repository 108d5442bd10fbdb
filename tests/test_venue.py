"""A stub venue over a folder: one request a page, pushed filters, tries, a stream that goes on where it was."""

import os
from datetime import datetime, timedelta

import pytest

from strandline.sources.venue import register_venue

START = datetime(2024, 1, 1)
SCHEMA = "symbol string, time timestamp_ntz, close double"


def functions():
    """Made here, so that workers get them whole: tests are no module to them."""

    def fetch(options, symbol, first, last):
        """Hourly candles; each request leaves a file, and the first of page `broken` fails."""
        import os
        import uuid

        import pandas as pd

        log = options["log"]
        with open(f"{log}/{symbol}.{first:%d%H}.{last:%d%H}.{uuid.uuid4().hex}", "w"):
            pass
        if options.get("broken") == f"{symbol}.{first:%d%H}" and sum(f.startswith(f"{symbol}.{first:%d%H}") for f in os.listdir(log)) < int(options.get("fails", 2)):
            raise OSError("no answer")
        times = pd.date_range(first.replace(minute=0) - pd.Timedelta(hours=1), last, freq="h")  # one more at each end
        return pd.DataFrame({"time": times[::-1], "close": [float(t.day * 100 + t.hour) for t in times[::-1]]})

    def clock(options):
        from datetime import datetime

        with open(f"{options['log']}/../now") as f:
            return datetime.fromisoformat(f.read())

    return fetch, clock


@pytest.fixture
def venue(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "now").write_text("2024-01-03T05:30:00")
    fetch, clock = functions()
    register_venue(spark, "stub", fetch, SCHEMA, clock)

    def load(stream=False, **options):
        r = (spark.readStream if stream else spark.read).format("stub").option("log", f"{tmp_path}/log").option("wait", 0.01)
        return r.options(symbols="aa,bb", start="2024-01-01T00:00:00", minutes=60, block=24, **options).load()

    return load, lambda: sorted(f.rsplit(".", 1)[0] for f in os.listdir(tmp_path / "log")), tmp_path


def test_one_request_a_page(venue):
    load, asked, _ = venue
    df = load(end="2024-01-03T12:00:00")
    got = df.collect()
    assert len(got) == 2 * 60 and {(r["symbol"], r["time"]) for r in got} == {(s, START + timedelta(hours=k)) for s in ("aa", "bb") for k in range(60)}
    assert all(r["close"] == r["time"].day * 100 + r["time"].hour for r in got)
    assert asked() == [f"{s}.{p}" for s in ("aa", "bb") for p in ("0100.0200", "0200.0300", "0300.0312")]


def test_only_asked_for_pages_are_read(venue):
    load, asked, _ = venue
    df = load(end="2024-01-31T00:00:00")
    got = df.where("symbol = 'bb' and time >= timestamp_ntz'2024-01-04 06:00:00' and time < timestamp_ntz'2024-01-05 03:00:00'").collect()
    assert len(got) == 21 and all(r["symbol"] == "bb" for r in got)
    assert asked() == ["bb.0406.0500", "bb.0500.0503"]
    assert load(end="2024-01-31T00:00:00").where("symbol in ('bb', 'cc') and time = timestamp_ntz'2024-01-09 04:00:00'").count() == 1
    assert len(asked()) == 3
    assert load(end="2024-01-31T00:00:00").where("symbol = 'zz'").count() == 0 and len(asked()) == 3


def test_a_failed_page_is_tried_again(venue):
    load, asked, _ = venue
    assert load(end="2024-01-03T00:00:00", broken="aa.0200", fails=3).count() == 96
    assert asked().count("aa.0200.0300") == 3 and asked().count("aa.0100.0200") == 1
    with pytest.raises(Exception, match="no answer"):
        load(end="2024-01-03T00:00:00", broken="bb.0200", fails=1000, tries=2).count()


def test_stream_goes_on(spark, venue):
    load, asked, folder = venue

    def run():
        q = load(stream=True).writeStream.format("parquet").option("checkpointLocation", f"file://{folder}/cp").option("path", f"file://{folder}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    assert spark.read.parquet(f"file://{folder}/out").count() == 2 * 53  # the candle of 05:00 isn't over
    before = len(asked())
    (folder / "now").write_text("2024-01-03T07:10:00")
    run()
    rows = spark.read.parquet(f"file://{folder}/out")
    assert rows.count() == 2 * 55 == rows.distinct().count() and asked().count("aa.0305.0307") == 1 and len(asked()) == before + 2


def test_options_are_needed(spark, venue):
    with pytest.raises(Exception, match="symbols and start"):
        spark.read.format("stub").load().count()
