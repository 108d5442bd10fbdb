"""A paged venue as a Spark data source: `spark.read.format(name)` and `spark.readStream.format(name)`.

A venue answers one request for one page: a symbol and a span of time of `block` candles at most. Each page is a partition, so pages are fetched
side by side, a page that fails is tried again by itself, and a lost executor costs its pages only. Filters on symbol and time are pushed
down to the pages: what isn't asked for isn't requested. The stream's offset is the time up to which candles were read.

Options: symbols (comma-separated), start, end (ISO 8601, UTC; end excluded, the clock's time if there is none), minutes (of a candle), block (candles of a page),
tries, wait (seconds before the next try, doubled each time), and any that the venue's own functions look at.
"""

from __future__ import annotations

import time as clock_time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

EPOCH = datetime(1970, 1, 1)


@dataclass
class Page(InputPartition):
    """first <= time < last."""

    symbol: str
    first: datetime
    last: datetime


def _plain(x: datetime | str) -> datetime:
    x = datetime.fromisoformat(x) if isinstance(x, str) else x
    return x.astimezone(timezone.utc).replace(tzinfo=None) if x.tzinfo else x


def now(options: dict) -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Request:
    """What is asked for: symbols and a span of time, narrowed by pushed filters; and how pages are cut and fetched."""

    def __init__(self, schema: StructType, options: dict, fetch: Callable, clock: Callable) -> None:
        self.schema, self.options, self.fetch = schema, dict(options), fetch
        self.symbols = [x.strip() for x in options.get("symbols", "").split(",") if x.strip()]
        if not self.symbols or "start" not in options:
            raise ValueError("a venue is read with the options symbols and start")
        self.first = _plain(options["start"])
        self.last = _plain(options["end"]) if "end" in options else clock(self.options)
        self.candle = timedelta(minutes=float(options.get("minutes", 1)))
        self.block = int(options.get("block", 200))
        self.tries, self.wait = int(options.get("tries", 4)), float(options.get("wait", 0.5))

    def narrow(self, f) -> bool:
        """Whether a filter is answered by the pages alone; those on time may leave rows of a page to be filtered."""
        column, tick = f.attribute, timedelta(microseconds=1)
        if column == ("symbol",) and isinstance(f, (EqualTo, In)):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.symbols = [s for s in self.symbols if s in wanted]
            return True
        if column == ("time",) and isinstance(getattr(f, "value", None), datetime):
            at = _plain(f.value)
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.first = max(self.first, at)
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.last = min(self.last, at + (timedelta(0) if isinstance(f, LessThan) else tick))
        return False

    def pages(self, first: datetime, last: datetime) -> list[Page]:
        """Pages lie on a grid from 1970 on, so one span is always cut alike; the first and the last are cut short."""
        span, out = self.candle * self.block, []
        for s in self.symbols:
            at = EPOCH + (first - EPOCH) // span * span
            while at < last:
                out.append(Page(s, max(at, first), min(at + span, last)))
                at += span
        return out

    def rows(self, page: Page | None) -> Iterator[pa.RecordBatch]:
        if page is None:  # no page is asked for
            return
        for k in range(self.tries):
            try:
                got = self.fetch(self.options, page.symbol, page.first, page.last)
                break
            except Exception:
                if k + 1 == self.tries:
                    raise
                clock_time.sleep(self.wait * 2**k)
        if got is None or not len(got):
            return
        got = got.assign(symbol=page.symbol) if "symbol" in self.schema.names else got
        got = got[(got["time"] >= page.first) & (got["time"] < page.last)].drop_duplicates("time").sort_values("time")
        yield from pa.Table.from_pandas(got[self.schema.names], to_arrow_schema(self.schema), preserve_index=False).to_batches()


class PageReader(DataSourceReader):
    def __init__(self, request: Request) -> None:
        self.request = request

    def pushFilters(self, filters):
        for f in filters:
            if not self.request.narrow(f):
                yield f

    def partitions(self):
        return self.request.pages(self.request.first, self.request.last)

    def read(self, partition):
        return self.request.rows(partition)


class PageStream(DataSourceStreamReader):
    """Whole candles only: an offset is the clock's time, cut down to a candle."""

    def __init__(self, request: Request, clock: Callable) -> None:
        self.request, self.clock = request, clock

    def initialOffset(self) -> dict:
        return {"until": self.request.first.isoformat()}

    def latestOffset(self) -> dict:
        r = self.request
        at = clock_at if (clock_at := self.clock(r.options)) < r.last or "end" not in r.options else r.last
        return {"until": max(r.first, EPOCH + (at - EPOCH) // r.candle * r.candle).isoformat()}

    def partitions(self, start: dict, end: dict):
        return self.request.pages(_plain(start["until"]), _plain(end["until"]))

    def read(self, partition):
        return self.request.rows(partition)


def register_venue(spark: SparkSession, name: str, fetch: Callable[[dict, str, datetime, datetime], pd.DataFrame | None], schema: str, clock: Callable[[dict], datetime] = now) -> None:
    """Makes `name` a format. fetch(options, symbol, first, last) gives a page's rows with a column time (UTC, without zone), in any order; more than were asked for may come. It runs in tasks, so it is pickled."""

    class Venue(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> PageReader:
            return PageReader(Request(schema, self.options, fetch, clock))

        def streamReader(self, schema: StructType) -> PageStream:
            return PageStream(Request(schema, self.options, fetch, clock), clock)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Venue)
