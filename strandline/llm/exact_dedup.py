"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is a run of (digest, best row, count) entries. In round k the runs of `fan_in` neighbouring
parents are merged into one: Spark shuffles the entries by (parent, digest), sorts them, and a streaming sort
aggregation joins the equal digests of the runs, keeping the best row and the sum of the counts. Partial
aggregation sorts and merges before the shuffle, so a digest that a third of all rows share is one entry a run from
the first round on. After ceil(log(runs)/log(fan_in)) rounds one run spread over all tasks is left.

Digests are verified by the length in bytes of the normalised text, which is part of the key in every round.

Defined results: a null text is empty; empty texts are equal to each other; a null id sorts after all others; rows that
repeat an id are all marked like that id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_skewed, text_of, written


def tree_merge(entries: DataFrame, keys: list[str], best: str, fan_in: int = 8) -> DataFrame:
    """entries(keys, best, run) -> one row for each key: smallest `best`, and `group_size`. Rounds depend on the runs only."""
    runs = (entries.agg(F.max("run")).first()[0] or 0) + 1
    level = entries.withColumn("group_size", F.lit(1).cast("long"))
    stride = 1
    while True:
        stride *= fan_in
        parent = F.col("run") - F.col("run") % stride
        level = level.groupBy(*keys, parent.alias("run")).agg(F.min(best).alias(best), F.sum("group_size").alias("group_size"))
        if stride >= runs:
            return level.drop("run")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_of(text_col)
    norm = F.translate(text, SPACE, "")
    return df.select(
        F.col(id_col).alias("_id"), F.unhex(F.sha2(norm, 256)).alias("_digest"), F.octet_length(norm).alias("_bytes"),
        F.struct(F.col(id_col).isNull().alias("no_id"), (-F.char_length(text)).alias("shorter"), F.col(id_col).alias("id")).alias("_best"), F.spark_partition_id().alias("run"),
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row for each row of df: id_col, keep_id, group_size, kept, text_sha256. Columns of df other than the two are not read."""
    own = written(digests(df, id_col, text_col))
    merged = tree_merge(own.select("_digest", "_bytes", "_best", "run"), ["_digest", "_bytes"], "_best", fan_in)
    groups = written(merged.where("group_size > 1").select("_digest", "_bytes", F.col("_best.id").alias("keep_id"), "group_size"))
    out = join_skewed(own.select("_id", "_digest", "_bytes"), groups, ["_digest", "_bytes"], "group_size", own.count())
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_groups drops; all columns stay, whatever their names. Ids are taken to be unique; rows with a null id stay."""
    gone = exact_groups(df, id_col, text_col).where("not kept").select(id_col)
    return df.join(gone, id_col, "left_anti")
