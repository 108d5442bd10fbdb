"""Running sums and carried values over a key's whole history without a task that holds it: windows stay in blocks of time.

Each (key, block) is summed up in one row with partial aggregation; a window over these few rows tells what comes before each block, and the rows of a
block take that from a join. What is within the block is a window by key and block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows up to which the summaries of blocks are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000
BLOCK = "1 day"


def block_of(df: DataFrame, time: str, width: str | int = BLOCK) -> Column:
    """The block of a row: for a time, so many units ('6 hours') since 1970, for a number, so many of it. Null times are in a block of their own."""
    kind = next(f.dataType.typeName() for f in df.schema if f.name == time)
    if not kind.startswith("timestamp"):
        return F.floor(F.col(time) / int(width) if not isinstance(width, str) else F.col(time) / 4096)
    n, unit = width.split() if isinstance(width, str) else (width, "seconds")
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (int(n) * seconds * 1_000_000))


def sized(side: DataFrame) -> DataFrame:
    """side with a broadcast hint if a bounded look at it shows that it has few rows."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def before_blocks(df: DataFrame, keys: list[str], block: str, sums: dict[str, Column] | None = None, lasts: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """df with columns of what is in the blocks of its key before its own: `sums` name -> summed column (0 if there is none), `lasts` name -> (value, order): the last value that isn't null by order (null if there is none)."""
    sums, lasts = sums or {}, lasts or {}
    aggs = [F.sum(c).alias(n) for n, c in sums.items()] + [F.max(F.when(v.isNotNull(), F.struct(o.alias("o"), v.alias("v")))).alias(n) for n, (v, o) in lasts.items()]
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*keys, block).agg(*aggs)
    told = parts.select(*keys, block, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums], *[F.last(n, ignorenulls=True).over(w)["v"].alias(n) for n in lasts])
    return df.join(sized(told), [*keys, block])


def within(keys: list[str], block: str, *order: str) -> WindowSpec:
    return Window.partitionBy(*keys, block).orderBy(*order)


def by_block(bars: DataFrame, add: Callable[[DataFrame], DataFrame], before: int, after: int = 0, block: int = 4096) -> DataFrame:
    """add(bars), where add makes windows by symbol and bar_id that look at most `before` rows back and `after` ahead, all its steps together.

    The windows run by symbol and block of `block` bar numbers; a block has the rows of its neighbours in reach besides its own, and gives out its
    own only. So a task holds block + before + after rows, whatever the symbol's history; bar_id is dense. add keeps the columns that it gets.
    """
    place = lambda x: F.floor(x / block)
    at = F.col("bar_id")
    rows = bars.withColumn("_block", F.explode(F.sequence(F.greatest(place(at - after), F.lit(0)), place(at + before)))).withColumn("_symbol", F.col("symbol"))
    out = add(rows.withColumn("symbol", F.struct("_symbol", "_block")))
    return out.where(place(at) == F.col("_block")).withColumn("symbol", F.col("_symbol")).drop("_symbol", "_block")
