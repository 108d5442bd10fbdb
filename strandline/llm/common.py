"""Shared pieces of the corpus operators: written intermediates, sized joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, return.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a joined side may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir. Where that is unset, one of this machine under a local master, and an error on a cluster."""
    conf = spark.sparkContext.getConf()
    if root := conf.get("spark.checkpoint.dir", None) or getattr(spark, "_strandline_shared", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
    spark._strandline_shared = "file://" + tempfile.mkdtemp(prefix="strandline-")
    return spark._strandline_shared


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, is read by columns. The session's end deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 500, size: str = "16m") -> None:
    """Arrow batches of at most so many rows and about that size from now on in this session, unless less is set: rows here are whole texts.

    Plans are made when they run, after this returns, so it can't be put back; other Arrow functions only get smaller batches.
    """
    key, most = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    if not getattr(spark, "_strandline_bytes", False):
        spark.conf.set(most, size)
        spark._strandline_bytes = True


def text_of(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fit_broadcast(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """side with a broadcast hint if a bounded look at it shows that it has at most so many rows."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """Left join where right has unique keys and `weight` is how many rows of left have the key.

    Keys with at least 1/share of all rows are at most `share` keys, so that part of right is broadcast;
    what is left has no key with more rows than that and is joined by a shuffle.
    """
    hot = F.broadcast(right.where(F.col(weight) * share >= total))
    cold = right.where(F.col(weight) * share < total)
    return left.join(hot, keys).unionByName(left.join(hot, keys, "left_anti").join(cold, keys, "left"))


#: Rows of 4 KB that a bitmap of ids may have: 64 MB, some eight bits for each of 64 million ids.
BITMAP_ROWS, BITS_EACH = 16_384, 8


def maybe_in(left: DataFrame, ids: DataFrame, id_col: str = "id", most: int = BITMAP_ROWS) -> DataFrame:
    """left with a column `maybe`: false only for rows whose id is not in ids.

    A bitmap of hashed ids, with BITS_EACH or more bits for each, is broadcast, so left is not shuffled; an exact join of what is left
    follows where it matters. Where that takes more than `most` rows of 4 KB, left is joined by id and `maybe` is exact.
    """
    n = ids.count()
    blocks = max(16, 1 << (n * BITS_EACH // 32768).bit_length())
    if blocks > most:
        told = ids.select(id_col).distinct().withColumn("maybe", F.lit(True))
        return left.join(told, id_col, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
    spot = lambda: F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks * 32768))
    maps = ids.select(F.floor(spot() / 32768).alias("_block"), (spot() % 32768).alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    marked = left.withColumn("_block", F.floor(spot() / 32768)).withColumn("_bit", spot() % 32768).join(F.broadcast(maps), "_block", "left")
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return marked.withColumn("maybe", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) > 0, F.lit(False))).drop("_block", "_bit", "_map")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(u, v) -> (id, component): the smallest id reachable. Nodes without an edge to another node are not listed.

    Alternating large-star and small-star rounds; each is a few joins and aggregations and is written to the
    shared folder. Nothing is collected but two counters a round.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e)
    for _ in range(max_rounds):
        heads = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        if not e.take(1) or (not heads.where("n > 1").take(1) and not e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").take(1)):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # The centre of a big component has as many rows as neighbours, of 16 bytes each; a partition that they fill is split by the adaptive skew join.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
