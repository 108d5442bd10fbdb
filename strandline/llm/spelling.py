"""Spelling variants: words within one edit of each other, by a positional q-gram inverted index with a count filter.

Words are counted in Arrow batches and summed by Spark. For pairs whose longer word has L code points, q = L div 2: the first
and the last q-gram of a word don't overlap, so one edit leaves one of them as it is and in its place (from the end, for the last).
They are the prefix of the index: a word goes to the groups (L, its first q-gram) and (L, its last q-gram), once with
L its own length and once as the shorter word of a pair, L its length plus one. A group of more than GROUP words is dealt again by the same
rule on what its key leaves open, until the keys leave one position open and a group can't hold more words than the alphabet.

In a group, held by one task with at most max(GROUP, alphabet) words, the 2-grams of the open part (with a mark at each end) are indexed by
position; for each longer word the posting lists of its grams, at the same position in words of its length and at most one before
in shorter ones, are heap-merged, and the words met at least M - 1 times (M + 1 grams of M open code points, an edit spoils two) are
verified. Pairs that meet in two groups are made one by Spark. A word's form is its near word of largest count; roots come from
pointer jumping, in rounds that double how far each word sees. No list is pairs of all words of a group.

Defined results: null text has no words; a null id is hashed as the text `null`; rows that repeat an id are read each; ties of
forms go to the smallest word in code-point order; an empty table, or one without frequent words, gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_broadcast, text_batches, text_of, written

RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
LEAST_LENGTH, LEAST_COUNT, SLIP = 5, 3, 97
GROUP = 512
#: Distinct words that a task holds before it hands on what it has counted.
FLUSH = 200_000
_lower = {k: k + 32 for k in range(65, 91)}


def words_of(id_: object, text: str, slip: int = SLIP) -> Iterator[tuple[str, int]]:
    """(word, how often) of a text, where one in `slip` distinct words of a document loses a code point, as the hash says."""
    seed = zlib.crc32(f"{'null' if id_ is None else id_}:".encode())
    for run, n in Counter(RUN.findall(text)).items():
        run = run.translate(_lower)
        h = zlib.crc32(run.encode(), seed)
        if h % slip == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """word, n (long) of the words that occur at least `least` times."""

    def count(batches: Iterator[pa.RecordBatch]):
        held: dict[str, int] = defaultdict(int)
        for b in batches:
            for id_, text in zip(b.column(0).to_pylist(), b.column(1)):
                for w, n in words_of(id_, text.as_py()):
                    held[w] += n
                if len(held) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    text_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _deal(rows: DataFrame) -> DataFrame:
    """rows(word, n, top, head, tail) twice: once with the first and once with the last q-gram of the open part fixed as well."""
    q = F.expr("(top - head - tail) div 2").cast("int")
    sides = F.array(F.struct((F.col("head") + q).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + q).alias("tail")))
    out = rows.withColumn("side", F.explode(sides)).select("word", "n", "top", "side.head", "side.tail")
    return out.withColumn("key", _key())


def _key() -> Column:
    end = F.expr("substring(word, char_length(word) - tail + 1, tail)")
    return F.concat_ws(" ", "top", "head", "tail", F.expr("substring(word, 1, head)"), end)


def grouped(words: DataFrame, group: int = GROUP) -> DataFrame:
    """words(word, n) -> word, n, top, head, tail, key: any two words within one edit share a key, and no key has more than `group` words unless it leaves one position open."""
    size = F.char_length("word").cast("int")
    level = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("top"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    level, ready = written(_deal(level)), None
    while True:
        hot = level.where("top - head - tail > 1").groupBy("key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > group).select("key")
        hot = written(hot)
        done = not hot.take(1)
        some = level if done else level.join(fit_broadcast(hot), "key", "left_anti")
        ready = some if ready is None else ready.unionByName(some)
        if done:
            return ready
        level = written(_deal(level.join(fit_broadcast(hot), "key", "left_semi")))


def one_edit(a: str, b: str) -> bool:
    """Whether a becomes b by exactly one inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def pairs_of(words: list[str], top: int, head: int, tail: int) -> Iterator[tuple[int, int]]:
    """Positions of the pairs within one edit among words of `top` code points, or one of them and one of one less, that share `head` leading and `tail` trailing code points."""
    order = sorted(range(len(words)), key=lambda i: (len(words[i]), words[i]))
    if not order or len(words[order[-1]]) < top or len(order) < 2:
        return
    open_ = top - head - tail
    bound = open_ - 1
    postings: tuple[dict, dict] = (defaultdict(list), defaultdict(list))  # of the shorter and of the longer words: (position, gram) -> numbers, rising
    for number, i in enumerate(order):
        word = words[i]
        middle = f"\0{word[head : len(word) - tail]}\1"
        grams = [(k, middle[k : k + 2]) for k in range(len(middle) - 1)]
        own = postings[len(word) == top]
        if len(word) == top:
            if bound > 0:
                lists = [own[g] for g in grams if g in own]
                lists += [postings[0][x, g] for k, g in grams for x in (k - 1, k) if (x, g) in postings[0]]
                near = (other for other, met in groupby(merge(*lists)) if sum(1 for _ in met) >= bound)
            else:
                near = range(number)
            for other in near:
                if one_edit(word, words[order[other]]):
                    yield i, order[other]
        for g in grams:
            own[g].append(number)


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """words(word, n) -> word, n, other, other_n: all ordered pairs of words within one edit."""

    def work(batches: Iterator[pa.RecordBatch]):
        key, held = None, []

        def found():
            names, counts = [x[0] for x in held], [x[1] for x in held]
            p = list(pairs_of(names, *held[0][2:]))
            if p:
                i, j = [x for x, _ in p], [y for _, y in p]
                cols = [[names[k] for k in i], [counts[k] for k in i], [names[k] for k in j], [counts[k] for k in j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64()) * 2)], ["word", "n", "other", "other_n"])

        for b in batches:
            for k, *row in zip(*(b.column(x).to_pylist() for x in ("key", "word", "n", "top", "head", "tail"))):
                if k != key:
                    if len(held) > 1:
                        yield from found()
                    key, held = k, []
                held.append(row)
        if len(held) > 1:
            yield from found()

    text_batches(words.sparkSession)
    rows = grouped(words, group).repartition("key").sortWithinPartitions("key")
    once = rows.mapInArrow(work, "word string, n long, other string, other_n long")
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return once.select(both.alias("p")).select("p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form), where no path returns to a word -> word, root: the last word on the path."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(at.join(fit_broadcast(ahead), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.where("moved").take(1):
            return at


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row for each frequent word of df: word, form, root, n, n_near, form_n."""
    words = written(word_counts(df, id_col, text_col))
    near = near_pairs(words, group).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.max(F.col("other_n")).alias("most"), F.min(F.struct((-F.col("other_n")).alias("rarer"), F.col("other"))).alias("best")
    )
    told = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("most") >= 2 * F.col("n"), F.struct(F.col("best.other").alias("form"), F.col("most").alias("form_n"))).alias("f")))
    told = told.select("word", "f.form", "n", "n_near", "f.form_n")
    found = roots(told.where("form is not null").select("word", "form"))
    return told.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
