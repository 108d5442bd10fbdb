"""Market metadata: repaired header cells, symbols of venues, universes, status, shares of volume, ranks, backdated figures, news and candles out of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.windows import col

#: A ticker whose futures bear another name, and that name.
RENAMED = {"LUNA": "LUNA2", "DODO": "DODOX", "BEAM": "BEAMX"}
#: What a wallet's status is to be for deposits and for withdrawals.
CAN_DEPOSIT, CAN_WITHDRAW = ("working", "deposit_only"), ("working", "withdraw_only")
CANDLE = "array<struct<candle_date_time_utc:string,opening_price:double,high_price:double,low_price:double,trade_price:double,candle_acc_trade_volume:double>>"
NEWS = "struct<data:struct<notices:array<struct<id:long,title:string,listed_at:string>>>>"


def repaired(cell: str | Column) -> Column:
    """A cell of a header row that was data: of several decimal points only the first stays. Numbers and true or false are cast by the schema."""
    c = col(cell)
    first = F.substring_index(c, ".", 1)
    rest = F.replace(F.substring(c, F.length(first) + 2, F.length(c)), F.lit("."), F.lit(""))
    return F.when(F.regexp_count(c, F.lit(r"\.")) > 1, F.concat(first, F.lit("."), rest)).otherwise(c)


def months_between(df: DataFrame, time: str, key: str = "symbol", step: str = "interval 1 month") -> DataFrame:
    """key, partition: the first of each month (or each step) from a key's first to its last time: what is to be scanned."""
    span = df.groupBy(key).agg(F.date_trunc("month", F.min(time)).cast("date").alias("a"), F.max(time).cast("date").alias("b"))
    return span.select(key, F.explode(F.sequence("a", "b", F.expr(step))).alias("partition"))


def to_symbols(tickers: DataFrame, spot: DataFrame, futures: DataFrame) -> DataFrame:
    """ticker -> spot symbol X/USDT and futures symbol X/USDT:USDT, or 1000X/USDT:USDT where that is traded; null where it isn't. spot and futures hold `base`."""
    s = spot.select(F.col("base").alias("ticker"), F.concat("base", F.lit("/USDT")).alias("spot")).distinct()
    f = futures.select(F.regexp_replace("base", "^1000", "").alias("ticker"), F.col("base").startswith("1000").alias("kilo"), "base").distinct()
    f = f.groupBy("ticker").agg(F.concat(F.max_by("base", "kilo"), F.lit("/USDT:USDT")).alias("futures"))
    return tickers.join(s, "ticker", "left").join(f, "ticker", "left")


def to_ticker(symbol: str | Column) -> Column:
    """The inverse of to_symbols' columns."""
    base = F.regexp_replace(F.regexp_replace(col(symbol), "/USDT(:USDT)?$", ""), "1000", "")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in RENAMED.items() for x in (v, k)]), base), base)


def both_markets(spot: DataFrame, futures: DataFrame) -> DataFrame:
    """Bases traded in both: spot, futures. The same name comes first, then 1000 of it, then the renamed ones: one equi-join on candidates."""
    other = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in list(RENAMED.items())[:2] for x in kv]), F.col("base")), F.lit("-"))
    tries = spot.select(F.col("base").alias("spot"), F.posexplode(F.array(F.col("base"), F.concat(F.lit("1000"), F.col("base")), other)).alias("rank", "futures"))
    return tries.join(futures.select(F.col("base").alias("futures")).distinct(), "futures").groupBy("spot").agg(F.min_by("futures", "rank").alias("futures"))


def volume_share(pairs: DataFrame, listed: list[str], exchange: str = "exchange", volume: str = "volume") -> DataFrame:
    """The share of volume on the exchanges listed, in percent of all."""
    return pairs.agg((100 * F.sum(F.when(F.col(exchange).isin(listed), F.col(volume)).otherwise(0)) / F.sum(volume)).alias("share"))


def dominant(pairs: DataFrame, exchange: str = "exchange", volume: str = "volume") -> DataFrame:
    """The exchange with the most volume, the first by name of equals."""
    return pairs.groupBy(exchange).agg(F.sum(volume).alias(volume)).orderBy(F.desc(volume), exchange).limit(1)


def best_ranked(df: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """key, value of the smallest rank; null ranks come last, then the smallest value."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(F.col(rank).isNull(), F.col(rank), F.col(value))).alias(value))


def backdated_volume(events: DataFrame, quotes: DataFrame, days: int, key: str = "symbol") -> DataFrame:
    """events with the mean of volume * close over the `days` days before their date. quotes: key, date, volume, close; each quote meets the dates it counts for."""
    q = quotes.select(key, F.explode(F.sequence(F.date_add("date", 1), F.date_add("date", days))).alias("date"), (F.col("volume") * F.col("close")).alias("_d"))
    mean = q.join(events.select(key, "date").distinct(), [key, "date"], "left_semi").groupBy(key, "date").agg(F.avg("_d").alias("dollars"))
    return events.join(mean, [key, "date"], "left")


def candles(json: str | Column) -> Column:
    """An array of candles out of a venue's JSON, in ascending time."""
    return F.array_sort(F.transform(F.from_json(col(json), CANDLE), lambda c: F.struct(F.to_timestamp_ntz(c["candle_date_time_utc"], F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("time"), c["opening_price"].alias("open"), c["high_price"].alias("high"), c["low_price"].alias("low"), c["trade_price"].alias("close"), c["candle_acc_trade_volume"].alias("volume"))))


def news(pages: DataFrame, json: str = "json", exchange: str = "exchange") -> DataFrame:
    """exchange, title, date, link of the notices in pages of announcements."""
    n = pages.select(exchange, F.explode(F.from_json(json, NEWS)["data"]["notices"]).alias("n"))
    return n.select(exchange, "n.title", F.to_timestamp_ntz("n.listed_at", F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("date"), F.concat(F.lit("/notice?id="), F.col("n.id")).alias("link"))


def listed_markets(markets: DataFrame, quote: str, kind: str | None = None, active: bool | None = True) -> DataFrame:
    """markets(base, quote, type, active, ...) of one quote, of one type (spot, swap) and active or not, where these are asked for: filters that reach the scan. A null is none of them."""
    out = markets.where(F.col("quote") == quote)
    if kind is not None:
        out = out.where(F.col("type") == kind)
    return out if active is None else out.where(F.col("active") == active)
