"""Queries of the streaming operators, over a finished table: the same functions serve a stream (tests/test_streaming.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.sources.tables import TICKS
from strandline.streaming import monitor as M

from .registry import query


@query("x2_candles", f"with {TICKS} select symbol, time_bucket(interval 5 minute, time, timestamp '2000-01-01') as start, round(avg(price), 6) as price, round(sum(price * qty), 2) as dollars, count(*) as n from ticks group by all")
def x2(t):
    return M.candles(t.ticks).withColumn("price", F.round("price", 6)).withColumn("dollars", F.round("dollars", 2))


@query("x1_premium_alerts", f"with {TICKS}, w as (select start, symbol, price, qty from ticks, lateral (select unnest(generate_series(time_bucket(interval 30 minute, time, timestamp '2000-01-01') - interval 150 minute, time_bucket(interval 30 minute, time, timestamp '2000-01-01'), interval 30 minute)) as start) where symbol in ('click', 'view')), g as (select start, avg(case when symbol = 'click' then price end) / avg(case when symbol = 'view' then price end) - 1 as premium, sum(case when symbol = 'click' then price * qty end) as dollars from w group by start) select start, round(premium, 6) as premium, round(dollars, 2) as dollars from g where abs(premium) > 0.03 and dollars > 1000")
def x1(t):
    p = M.premiums(t.ticks, "click", "view", "3 hours", "30 minutes")
    return M.alerts(p, 0.03, 1000.0).select("start", F.round("premium", 6).alias("premium"), F.round("dollars", 2).alias("dollars"))
