"""Sharding by a k-d tree over the documents' metadata, with cuts at weighted medians.

A document is a point whose coordinates are its metadata (texts by hash, numbers by place in their range) and the logarithm of its
size, and whose weight is its size in bytes. A node that is to become k shards is cut along its widest dimension, so that the left
side holds as near to (k div 2) / k of its bytes as can be; nodes of one shard, about the target bytes, are leaves. Equal texts
are one point: their coordinates are the smallest of the group, and they are ordered next to each other by the text's hash
within a coordinate. So copies share a shard, unless a cut falls among copies that weigh over WHOLE of the node: these
are divided by the hash of the id.

A weighted median is found by a radix descent, for all nodes of a level at once: bytes are summed by (node, digit of the
key), the digit in which the median lies is kept, and the next digit is looked at among its points only. So no node, however hot its
source or group of copies, is sorted or meets in one task; windows run over at most 8192 sums a node. All is DataFrame work.

Slots number a shard's rows by a hash of id and text: rows are counted by (shard, range of the hash) and numbered within a range.

Defined results: null text has 0 bytes and size 1, its CRC is that of the empty text, and it is a copy of the empty text; a null coordinate is one
of its own, before all others; a null id is hashed as the text `null`; rows that repeat an id and its text stay together;
one document above the target is a shard of its own or shares one; there may be empty shards if documents are few; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import fit_broadcast, join_skewed, text_of, written

#: Copies up to this share of a node's bytes are never divided by its cut.
WHOLE = 0.01
SLOTS = 50_000


def _hash(value: Column, digits: int) -> Column:
    """The first hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def _size_place(size: Column) -> Column:
    """log2 of a positive size, in steps of about 1/1024."""
    k = F.length(F.bin(size)) - 1
    return k.cast("long") * 1024 + F.floor(size * 1024 / F.pow(F.lit(2.0), k)).cast("long") - 1024


def _place(df: DataFrame, name: str) -> Column:
    """A coordinate from 0 to 65536: 0 is null, a number's is its place in the column's range, a text's a hash."""
    kind = next(f.dataType for f in df.schema if f.name == name)
    if not isinstance(kind, NumericType):
        return F.coalesce(_hash(F.col(name).cast("string").cast("binary"), 4) + 1, F.lit(0))
    x = F.col(name).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    return F.coalesce(F.floor((x - low) / max((high or 0) - (low or 0), 1e-300) * 65535).cast("long") + 1, F.lit(0))


def points(df: DataFrame, dims: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """One row for each row of df: id, size, text_crc32, tie and pick (32-bit hashes of text and id), seat (of both), and coordinates c0, c1, ...; those of equal texts are equal."""
    text, name = text_of(text_col).cast("binary"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    places = [_place(df, d).alias(f"p{k}") for k, d in enumerate(dims)]
    own = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"), name.alias("name"), *places)
    digit = lambda x, n: F.conv(F.substring(x, 1, n), 16, 10).cast("long")
    own = own.withColumn("tie", digit(F.col("digest"), 8)).withColumn("pick", _hash(F.col("name").cast("binary"), 8))
    own = written(own.withColumn("seat", _hash(F.concat_ws(":", "name", "digest").cast("binary"), 8)).drop("name"))
    cs = [f"c{k}" for k in range(len(dims))]
    groups = own.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), *[F.min(f"p{k}").alias(c) for k, c in enumerate(cs)]).where("n > 1")
    out = join_skewed(own, written(groups), ["digest", "size"], "n", own.count())
    last = _size_place(F.col("size")).alias(f"c{len(dims)}")
    return out.select("id", "size", "text_crc32", "tie", "pick", "seat", *[F.coalesce(c, f"p{k}").alias(c) for k, c in enumerate(cs)], last)


def _cuts(rows: DataFrame, nodes: DataFrame, whole: float) -> DataFrame:
    """rows(low, key, pick, size), nodes(low, goal, total) -> low, key, whole, pick, last: where each node is cut.

    Left are the rows with a smaller key, and those with that key: all or none of them, as `last` says, if `whole`; else those with a
    smaller pick, and those with that pick if `last` says so.
    """
    cut = nodes.withColumns({"floor": F.lit(0).cast("long"), "key": F.lit(0).cast("long"), "pick": F.lit(0).cast("long")})

    def descend(cut: DataFrame, col: str, fixed: list[str], shift: int, width: int) -> DataFrame:
        """One more digit of the column: what is above it is known."""
        near = fit_broadcast(cut.select("low", "goal", "total", "floor", *[F.col(c).alias(f"_{c}") for c in ("key", "pick")]))
        at = F.shiftright(F.col(col), shift)
        inside = F.shiftright(F.col(col), shift + width) == F.col(f"_{col}")
        for c in fixed:
            inside &= F.col(c) == F.col(f"_{c}")
        sums = rows.join(near, "low").where(inside).groupBy("low", at.alias("digit")).agg(F.sum("size").alias("w"), *[F.first(c).alias(c) for c in ("goal", "total", "floor", "_key", "_pick")])
        sums = sums.withColumn("after", F.col("floor") + F.sum("w").over(Window.partitionBy("low").orderBy("digit")))
        sums = sums.where((F.col("after") > F.col("goal")) & (F.col("after") - F.col("w") <= F.col("goal")))
        known = {"key": F.col("_key"), "pick": F.col("_pick")} | {col: F.col("digit")}
        return written(sums.select("low", "goal", "total", (F.col("after") - F.col("w")).alias("floor"), "w", known["key"].alias("key"), known["pick"].alias("pick")))

    for shift, width in ((36, 13), (24, 12), (12, 12), (0, 12)):
        cut = descend(cut, "key", [], shift, width)
    heavy = F.col("w") > F.col("total") * whole
    last = F.col("goal") - F.col("floor") >= F.col("w") / 2
    done = cut.where(~heavy).select("low", "key", F.lit(True).alias("whole"), "pick", last.alias("last"))
    cut = cut.where(heavy)
    if not cut.take(1):
        return done
    for shift, width in ((21, 11), (10, 11), (0, 10)):
        cut = descend(cut, "pick", ["key"], shift, width)
    return written(done.unionByName(cut.select("low", "key", F.lit(False).alias("whole"), "pick", last.alias("last"))))


def kd_tree(pts: DataFrame, shards: int, whole: float = WHOLE) -> DataFrame:
    """points with a column shard, from 0 to shards - 1: the leaves from left to right."""
    cs = [c for c in pts.columns if c[0] == "c" and c[1:].isdigit()]
    at = written(pts.select("*", F.lit(0).alias("low"), F.lit(shards).alias("high")))
    root = at.agg(*[F.max(c).alias(f"max_{c}") for c in cs], *[F.min(c).alias(f"min_{c}") for c in cs]).first()
    for _ in range((shards - 1).bit_length()):
        split = at.where("high - low > 1")
        nodes = split.groupBy("low", "high").agg(F.sum("size").alias("total"), *[(F.max(c) - F.min(c)).alias(c) for c in cs])
        width = F.array(*[F.col(c).cast("double") / max((root[f"max_{c}"] or 0) - (root[f"min_{c}"] or 0), 1) for c in cs])
        mid = F.expr("low + (high - low) div 2").cast("int")
        goal = F.col("total") * (mid - F.col("low")) / (F.col("high") - F.col("low"))
        nodes = written(nodes.select("low", mid.alias("mid"), "total", goal.alias("goal"), F.array_position(width, F.array_max(width)).cast("int").alias("dim")))
        place = F.element_at(F.array(*cs), F.col("dim"))
        keyed = split.join(fit_broadcast(nodes.select("low", "dim")), "low")
        cuts = _cuts(keyed.select("low", (F.shiftleft(place, 32) + F.col("tie")).alias("key"), "pick", "size"), nodes.select("low", "goal", "total"), whole)
        sides = nodes.join(cuts.select("low", "whole", "last", F.col("key").alias("cut_key"), F.col("pick").alias("cut_pick")), "low").drop("total", "goal")
        key = F.shiftleft(place, 32) + F.col("tie")
        on_pick = (F.col("pick") < F.col("cut_pick")) | ((F.col("pick") == F.col("cut_pick")) & F.col("last"))
        left = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & F.when(F.col("whole"), F.col("last")).otherwise(on_pick))
        both = at.join(fit_broadcast(sides), "low", "left")
        at = both.select(*pts.columns, F.when(left | F.col("dim").isNull(), F.col("low")).otherwise(F.col("mid")).alias("low"), F.when(F.col("dim").isNull() | ~left, F.col("high")).otherwise(F.col("mid")).alias("high"))
        at = written(at)
    return at.select(*pts.columns, F.col("low").cast("int").alias("shard"))


def numbered(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """rows(shard, seat, id) with a column slot: from 0 without gaps in each shard, in the order of (seat, id)."""
    ranges = max(1, -(-rows.count() // (slots * shards)))
    rows = rows.withColumn("range", F.floor(F.col("seat") * F.lit(ranges) / F.lit(2.0**32)).cast("int"))
    counts = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "range", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "range").orderBy("seat", "id"))
    return rows.withColumn("own", own).join(fit_broadcast(starts), ["shard", "range"]).withColumn("slot", (F.col("before") + F.col("own") - 1).cast("long")).drop("own", "before", "range")


def kd_shards(df: DataFrame, shards: int | None = 8, dims: Sequence[str] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text", target_bytes: int | None = None) -> DataFrame:
    """One row for each row of df: id_col, size, text_crc32, law, shard, slot, grown_shard (null). With target_bytes as many shards as bring them to about that size."""
    pts = written(points(df, dims, id_col, text_col))
    if target_bytes:
        shards = max(1, -(-(pts.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    out = numbered(kd_tree(pts, shards), shards)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int | None = 8, dims: Sequence[str] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text", target_bytes: int | None = None) -> None:
    """df as Parquet under path, a folder `_shard=k` for each shard. Ids are taken to be unique and not null."""
    told = kd_shards(df, shards, dims, id_col, text_col, target_bytes).select(F.col(id_col).alias("_shard_id"), F.col("shard").alias("_shard"))
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row")).join(told, F.col(f"_row.`{id_col}`") == F.col("_shard_id"))
    rows.select("_row.*", "_shard").write.partitionBy("_shard").parquet(path)
