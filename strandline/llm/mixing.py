"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Longer documents are somewhat likelier: those of length class k (the number of binary
digits of the size) are wanted level * (TILT + k) times, where the level makes the source's words meet its target and no document is
wanted more than cap times. The whole part of that are certain copies, the rest p is the inclusion probability in a Pareto sample.
Documents are ranked by q = (u / (1 - u)) / (p / (1 - p)) with u a hash of (seed, id) in (0, 1), and the sample is the head of
that ranking which holds the residual words, to the nearest document. Where the head ends is found by a radix descent
on the rank: words are summed for each (source, digit), three digits deep, and only the last digit's few documents are
ordered in a window. A closing exchange then takes or leaves, in each source, the one document that brings its words nearest
to the target. All of it is DataFrame work; no source, however hot, meets in one task. Windows over all sources, or a source's
classes, run over a row for each source or class.

Defined results: null text or no word is size 0 and taken 0; a null source is a source of its own and comes last; a
source without words has target 0; a null id hashes as the text `null`; rows that repeat an id rank together in any order (and the
closing exchange turns all of them); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fit_broadcast, text_of, written

DIGITS, RADIX = 3, 1024
CYCLE = (1.0, 2.0, 3.0)
TILT = 4


def source_targets(sized: DataFrame, cap: float = 3.0) -> DataFrame:
    """sized(source, size) -> source, source_size, target: shares by weight of all words, none above cap times its words.

    Sources are ordered by code point, null last, and weigh 1, 2, 3, repeating. A source is at its cap if the level
    (words left for each unit of weight once all sources with a smaller cap for their weight are at theirs) passes it.
    The windows run over one row for each source.
    """
    every = Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), (place % len(CYCLE) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("room", F.col("most") / F.col("weight"))
    ranked = Window.orderBy("room", F.col("source").asc_nulls_last())
    order = ranked.rowsBetween(Window.unboundedPreceding, -1)
    spent, used = F.coalesce(F.sum("most").over(order), F.lit(0.0)), F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    level = (F.sum("source_size").over(every) - spent) / (F.sum("weight").over(every) - used)
    s = s.withColumn("level", level).withColumn("n", F.row_number().over(ranked))
    s = s.withColumn("level", F.min(F.when(F.col("room") >= F.col("level"), F.struct("n", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most").alias("target"))


def class_odds(classes: DataFrame, sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """classes(source, class, words) and source_targets -> one row for each class: certain copies and the inclusion probability p of the rest; residual: the words its source's sample is to hold.

    A document of class k is wanted level * (TILT + k) times, at most cap; the level of a source makes its words meet the
    target. Classes are at the cap from the longest down.
    """
    odds = F.col("class") + F.lit(TILT)
    c = classes.withColumn("weight", odds * F.col("words")).join(fit_broadcast(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    spent = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(cap)
    rest = F.sum("weight").over(down.rowsBetween(0, Window.unboundedFollowing))
    c = c.withColumn("level", (F.col("target") - spent) / rest.cast("double")).withColumn("n", F.row_number().over(down))
    level = F.min(F.when(F.col("level") * odds <= F.lit(cap), F.struct("n", "level"))).over(Window.partitionBy("source"))["level"]
    c = c.withColumn("wanted", F.least(F.lit(cap), F.coalesce(level, F.lit(cap)) * odds))
    c = c.withColumn("certain", F.floor("wanted").cast("long")).withColumn("p", F.col("wanted") - F.floor("wanted"))
    return c.withColumn("residual", F.col("target") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))).select("source", "class", "certain", "p", "residual")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", cap: float = 3.0) -> DataFrame:
    """One row for each row of df: id_col, source, size, source_size, target, copies, taken (= copies * size)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    own = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size.alias("size"), bits.alias("bits"))
    own = written(own.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size")))))
    classes = written(own.groupBy("source", "class").agg(F.sum("size").cast("long").alias("words")))
    targets = written(source_targets(classes.select("source", F.col("words").alias("size")), cap))
    odds = written(class_odds(classes.where("class is not null"), targets, cap))
    same = F.col("source").eqNullSafe(F.col("_source"))

    def beside(rows: DataFrame, small: DataFrame, how: str = "inner", on=None) -> DataFrame:
        """rows with what one row for each source (and class) tells."""
        small = small.withColumnsRenamed({k: f"_{k}" for k in ("source", "class")})
        return rows.join(fit_broadcast(small), same if on is None else same & on, how).drop("_source", "_class")

    docs = beside(beside(own, targets), odds, "left", F.col("class") == F.col("_class"))
    u = (F.col("bits") + 0.5) / float(2**48)
    # The rank q = (u / (1 - u)) / (p / (1 - p)) as q / (1 + q), which is in the same order and lies in (0, 1).
    rank = F.when((F.col("p") > 0) & (F.col("p") < 1), u * (1.0 - F.col("p")) / (u * (1.0 - F.col("p")) + (1.0 - u) * F.col("p")))
    docs = docs.withColumn("certain", F.coalesce("certain", F.lit(0).cast("long"))).withColumn("rank", rank)
    docs = written(docs.withColumn("place", F.least(F.floor(F.col("rank") * float(2**48)), F.lit(2**48 - 1))).drop("bits", "class", "p"))
    sampled = docs.where("rank is not null")

    # The descent on the digits of the rank: `floor` is the sum of all words that rank before the digits fixed so far.
    cut = odds.groupBy("source").agg(F.first("residual").alias("residual")).select("source", "residual", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("floor"))
    for d in range(DIGITS):
        width = 2 ** (48 - 10 * (d + 1))
        level = beside(sampled.select("source", "size", "place"), cut).where(F.floor(F.col("place") / (width * RADIX)) == F.col("prefix"))
        sums = level.groupBy("source", F.floor(F.col("place") / width).alias("digit")).agg(F.sum("size").alias("words"), F.first("floor").alias("floor"), F.first("residual").alias("residual"))
        w = Window.partitionBy("source").orderBy("digit")
        sums = sums.withColumn("after", F.col("floor") + F.sum("words").over(w))
        # The digit in which the residual lies; beyond all words no document is in question.
        at = sums.where((F.col("after") > F.col("residual")) & (F.col("after") - F.col("words") <= F.col("residual")))
        cut = written(at.select("source", "residual", F.col("digit").alias("prefix"), (F.col("after") - F.col("words")).alias("floor")))

    digit = F.floor(F.col("place") / 2 ** (48 - 10 * DIGITS))
    docs = beside(docs, cut.select("source", "prefix", "floor"), "left")
    w = Window.partitionBy("source").orderBy("rank", "_id").rowsBetween(Window.unboundedPreceding, -1)
    tie = docs.where(digit == F.col("prefix")).withColumn("before", F.col("floor") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    tie = tie.withColumn("head", F.col("before") + F.col("size") / 2 <= F.col("residual"))
    rest = docs.where(F.coalesce(digit != F.col("prefix"), F.lit(True))).withColumn("head", F.coalesce(digit < F.col("prefix"), F.lit(True)))
    keep = ["_id", "source", "size", "source_size", "target", "certain", "residual", "rank", "head"]
    every = written(rest.select(*keep).unionByName(tie.select(*keep)))
    # The closing exchange: in each source, the one document whose being taken or left brings the words nearest to the residual.
    ranked = F.col("rank").isNotNull()
    gap = every.where(ranked).groupBy("source").agg((F.first("residual") - F.sum(F.when(F.col("head"), F.col("size")).otherwise(0))).alias("gap"))
    side = beside(every.where(ranked), gap)
    turn = F.abs(F.col("gap") - F.when(F.col("head"), -F.col("size")).otherwise(F.col("size")))
    turned = side.where(turn < F.abs("gap")).groupBy("source").agg(F.min(F.struct(turn.alias("left"), F.col("_id").alias("id"))).alias("turned"))
    every = beside(every, turned, "left")
    head = F.col("head") != F.coalesce(F.col("_id") == F.col("turned.id"), F.lit(False))
    copies = F.col("certain") + F.when(ranked & head, 1).otherwise(0)
    every = every.select("_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))
    return every.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """df as the mix takes it: each row as often as it has copies. Ids are taken to be unique and not null; all columns stay, whatever their names."""
    wanted = mix(df, id_col, source_col, text_col, seed).where("copies > 0")
    wanted = wanted.select(F.col(id_col).alias("_mix_id"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_mix_copy"))
    # Joined on a struct of df's row, so that no name of df's columns is looked up next to the mix's.
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_mix_row"))
    return rows.join(wanted, F.col(f"_mix_row.`{id_col}`") == F.col("_mix_id")).select("_mix_row.*")
