"""The audit of filters against a document-by-document version: nulls, ties, repeated rows, clashing columns, long texts, empty tables."""

import re
from collections import Counter
from itertools import permutations

import pytest
from compare import connect, differences

from strandline.llm import queries as Q
from strandline.llm.filter_audit import audit, filter_audit

NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def plain(docs, labels):
    first, good, bad = {}, set(), set()
    for i, x, _ in docs:
        if i is not None:
            first[x or ""] = min(first.get(x or "", i), i)
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        bad |= {i} if t == 1 and i is not None else set()
    out, totals = {}, Counter()
    parts = {s or "" for *_, s in docs}
    for part in parts:
        failed = []
        for i, x, s in docs:
            if (s or "") == part:
                x = x or ""
                w = re.findall(r"[^\x20\x09-\x0D]+", x)
                f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 5 * len(x), "D": bool(re.search(r"[#$%&*|]", x))}
                f["E"] = i is not None and first[x] < i
                failed.append((i, {k for k, v in f.items() if v}))
        for p in permutations("ABCDE"):
            live = failed
            for step, letter in enumerate(p):
                row = [0] * 6
                row[2] = sum(letter in f for _, f in failed) - sum(letter in f for _, f in live)
                row[3] = sum(f == {letter} for _, f in failed)
                hit = [i for i, f in live if letter in f]
                live = [d for d in live if letter not in d[1]]
                row[0], row[1], row[4], row[5] = len(live), len(hit), sum(i in good for i in hit), sum(i in bad for i in hit)
                out[part, "".join(p), step + 1] = row
                totals[part, letter] += len(hit)
    return {(*k, *v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows():
    clean = " ".join(f"word{k}" for k in range(60))
    docs = [(1, clean, "a"), (2, clean, "a"), (2, clean, "b"), (3, clean + " #", None), (4, None, "a"), (5, "", ""), (None, clean, "a"), (None, None, None), (6, "A " * 70, "b")]
    docs += [(7, clean.upper(), "b"), (8, "\t\v" + clean + " x\f", "c"), (9, "x | Y", "c"), (10, "w " * 400_000, "a"), (11, "é" * 500_000 + "Z" * 26_316, "a"), (12, clean + " #", "b"), (12, "Q", "b")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (3, None, 1), (6, 1, None), (None, 1, 1), (12, 1, 0), (99, 1, 1), (5, 0, 1)]
    return docs, labels


def test_as_plain(spark):
    docs, labels = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as mask", "3 as id", "4 as _text", "'x' as step", "5 as _n").repartition(5)
    got = filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", df_lit()))
    names = ("part", "filter_order", "step", *NAMES, "shapley")
    found = [tuple(r[n] for n in names) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(docs, labels)


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_sql(spark, small):
    got = Q.queries()["op13_filter_audit"](spark, small).toPandas()
    assert not differences(got, connect(small).execute(Q.oracle_sql()["op13_filter_audit"]).df())
    assert (got.groupby("part").size() == 600).all()


def test_empty_and_wrong(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], none.schema)
    assert filter_audit(one, labels).count() == 600
    with pytest.raises(ValueError, match="at most"):
        audit(none.selectExpr("doc_id as id", "source as part", "0 as mask"), labels, "ABCDEFGH")
