"""Files as sources and sinks: zipped CSV archives, plain CSV, dated folders, paged venues, and where results go."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.markets import repaired

LINES = 50_000
#: The columns of the archives' files, in their order.
KLINES = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore")
TRADES = ("id", "price", "qty", "quote_qty", "time", "is_buyer_maker")


def read_zips(spark: SparkSession, path: str, columns: Sequence[str], wanted: dict[str, str], kinds: dict[str, str] | None = None, bad: str | None = None) -> DataFrame:
    """The first CSV of every zip (or the file itself, if it isn't one) under path: the wanted columns under new names, as doubles but for
    `kinds`; times in milliseconds where the kind is `ms`. Cells may be quoted.

    A first line that is not the header is data and has its cells repaired. A line of another number of cells is no row: with `bad` it is
    told in a column of that name, next to nulls, and without, the read fails with the file's name and the line. Blank lines are nothing. A file that
    can't be opened has no rows. Files are read line by line, each by one task; Arrow batches have at most 16 MB of files, or one.
    """
    names, told = list(columns), bad is not None
    if not getattr(spark, "_strandline_bytes", False):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")

    def lines(content: bytes) -> Iterator[str]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                yield from io.TextIOWrapper(f, "utf-8")
        except zipfile.BadZipFile:
            if b"\0" not in content[:4096]:
                yield from io.StringIO(content.decode("utf-8", "replace"))
        except (EOFError, IndexError, OSError):
            return

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b["path"].to_pylist(), b["content"]):
                held = []
                for k, line in enumerate(lines(content.as_py())):
                    cells = next(csv.reader([line.rstrip("\r\n")]), [])
                    if not cells or (k == 0 and cells == names):
                        continue
                    if len(cells) == len(names):
                        held.append((k == 0, None, *cells))
                    elif told:
                        held.append((False, line.rstrip("\r\n"), *[None] * len(names)))
                    else:
                        raise ValueError(f"{file}, line {k + 1}: {len(cells)} cells in place of {len(names)}")
                    if len(held) >= LINES:
                        yield _batch(held, names)
                        held = []
                if held:
                    yield _batch(held, names)

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "_first boolean, _bad string, " + ", ".join(f"`{c}` string" for c in names))
    cell = lambda c: F.when(F.col("_first"), repaired(c)).otherwise(F.col(c))
    return raw.select(*[_as((kinds or {}).get(c, "double"), cell(c)).alias(new) for c, new in wanted.items()], *([F.col("_bad").alias(bad)] if told else []))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.bool_()] + [pa.string()] * (len(names) + 1)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_first", "_bad", *names])


def _as(kind: str, x: Column) -> Column:
    return F.timestamp_millis(x.try_cast("double").cast("long")).cast("timestamp_ntz") if kind == "ms" else x.try_cast(kind)


def read_csv(spark: SparkSession, path: str, time: str = "Time", schema: str | None = None) -> DataFrame:
    """A CSV with header; times are milliseconds or text."""
    df = spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True)
    when = F.coalesce(F.timestamp_millis(F.col(time).try_cast("bigint")), F.try_to_timestamp(F.col(time).cast("string")))
    others = [F.col(c) if schema else F.coalesce(F.col(c).try_cast("double")).alias(c) for c in df.columns if c != time]
    return df.select(when.cast("timestamp_ntz").alias(time), *others)


def read_dates(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Parquet folders symbol=/date=; both are partition columns, so only the folders asked for are listed and read."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(*symbols))
    if first:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
    return df.where(F.col("date") <= F.lit(last).cast("date")) if last else df


def write_dates(df: DataFrame, path: str, time: str = "time") -> None:
    """The folders that read_dates reads; one that is there is left as it is."""
    df.withColumn("date", F.to_date(time)).repartition("symbol", "date").write.mode("ignore").partitionBy("symbol", "date").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").option("header", True).csv(path)


def pages(spark: SparkSession, symbols: Sequence[str], start: str, end: str, minutes: int, block: int = 200) -> DataFrame:
    """symbol, first, last: the blocks of so many candles that cover start..end, newest first as venues are paged; a row is a task's worth."""
    span = f"interval {minutes * block} minutes"
    s = spark.createDataFrame([(x,) for x in symbols], "symbol string")
    last = F.explode(F.reverse(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(span))))
    p = s.select("symbol", last.alias("first"))
    return p.select("symbol", F.col("first").cast("timestamp_ntz").alias("first"), F.least(F.col("first") + F.expr(span), F.lit(end).cast("timestamp")).cast("timestamp_ntz").alias("last"))


def fetched(pages_: DataFrame, fetch: Callable[[dict], pd.DataFrame | None], schema: str, tasks: int = 64) -> DataFrame:
    """The rows that fetch(page) gives for every page, in tasks: a venue's client, a stub over files, or any user function. A page without rows gives none;
    one that fails is tried again by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for page in pdf.to_dict("records"):
                got = fetch(page)
                if got is not None and len(got):
                    yield got

    return pages_.repartition(tasks, *pages_.columns).mapInPandas(run, schema)
