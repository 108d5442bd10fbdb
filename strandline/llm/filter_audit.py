"""Interaction audit of filters: what each removes, finds already removed or alone removes, in every order of them.

Each document is a mask, one bit for each filter that it fails. Documents are counted by (part, mask) first, so what follows is at most
parts * 2**filters cells whatever the number of documents. The cells are then brought into long form: each is unpivoted against
the steps of all orders, a running bit-or over the steps before says which filters have failed the cell by then, conditional sums over
the cells give the counts of a step, and a total over the window of a part's filter gives its Shapley value (times the number of orders).

Defined results: null text is empty, a null part is the empty string; a row whose id is null or repeated is a document of its own; the
filter of copies fails a row if a row with an equal text has a smaller id, so never a null id, and equal ids don't fail each other; a
document is good (toxic) if any of its label rows says 1, and a null label says nothing; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fit_broadcast, join_skewed, text_of, written

#: 7! orders of 128 masks are 4.5 million rows a part; more filters raise an error.
MOST_FILTERS = 7


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " +"), "")


def few_words(text: Column, words: Column, least: int = 50) -> Column:
    return F.size(words) < least


def repetitive(text: Column, words: Column, percent: int = 65) -> Column:
    return F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * percent


def shouting(text: Column, words: Column, percent: int = 5) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * percent


def symbols(text: Column, words: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Letter -> failure condition of (text, its words). The letter of COPIES fails copies of an earlier document.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols}
COPIES = "E"


def failures(df: DataFrame, filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, copies: str | None = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each row of df: id, part, mask. Bit k is the k-th filter's, the last one that of copies."""
    text, words = F.col("_text"), F.col("_words")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("_text")).withColumn("_words", _words(text))
    mask = sum((F.coalesce(f(text, words), F.lit(False)).cast("int") * (1 << k) for k, f in enumerate(filters.values())), F.lit(0))
    if not copies:
        return rows.select("id", "part", mask.alias("mask"))
    own = written(rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("_digest"), F.octet_length(text).alias("_bytes")))
    groups = own.groupBy("_digest", "_bytes").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = join_skewed(own, written(groups), ["_digest", "_bytes"], "_n", own.count())
    return out.select("id", "part", (F.col("mask") + F.coalesce(F.col("id") > F.col("_first"), F.lit(False)).cast("int") * (1 << len(filters))).alias("mask"))


def audit(failed: DataFrame, labels: DataFrame, letters: str, id_col: str = "doc_id") -> DataFrame:
    """failed(id, part, mask) -> for each part, order of the letters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    if len(letters) > MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"at most {MOST_FILTERS} filters of different letters")
    said = labels.groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(n) for c, n in (("quality", "good"), ("toxic", "bad"))])
    told = failed.join(fit_broadcast(said.where("good + bad > 0")), "id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    cells = failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).join(told, ["part", "mask"], "left").na.fill(0, ["good", "bad"])

    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    long = cells.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
    bit = F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)")
    long = long.withColumn("step", F.col("place") + 1).withColumn("bit", bit).withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("hit").over(before), F.lit(0)))

    hit, gone = F.col("hit") != 0, F.col("earlier") != 0
    total = lambda x, when: F.sum(F.when(when, F.col(x)).otherwise(0)).cast("long")
    steps = long.groupBy("part", "filter_order", "step", "letter").agg(
        total("n", ~hit & ~gone).alias("kept"), total("n", hit & ~gone).alias("removed"), total("n", hit & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("good", hit & ~gone).alias("good_lost"), total("bad", hit & ~gone).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).withColumn("step", F.col("step").cast("int")).drop("letter")


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of FILTERS and of copies over all of df, by part_col."""
    return audit(written(failures(df, id_col=id_col, text_col=text_col, part_col=part_col)), labels, "".join(FILTERS) + COPIES, id_col)
