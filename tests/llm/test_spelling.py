"""Spelling variants against all pairs of words in plain Python: hot groups, slips, nulls, ties, long runs, empty tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from compare import connect, differences

from strandline.llm import queries as Q
from strandline.llm.spelling import one_edit, roots, spelling_variants


def edits(a, b):
    """Edit distance by the plain recursion."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and edits(w, x) == 1] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def corpus(seed, alphabet, words=40):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.choice((4, 5, 5, 6, 7, 9, 12)))) for _ in range(words)]
    docs = []
    for i in range(120):
        text = []
        for _ in range(r.choice((0, 3, 60))):
            w = r.choice(base)
            for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
                k = r.randrange(len(w) + 1)
                w = r.choice((w[:k] + r.choice(alphabet) + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice(alphabet) + w[k + 1 :]))
            text += [w.upper() if r.random() < 0.1 else w] * r.choice((1, 1, 2, 5))
        docs.append((i * 7, r.choice((" ", "-", "\t", "9")).join(text)))
    return docs + [(None, docs[-1][1]), (None, None), (900, ""), (7, docs[1][1]), (901, "Ab×÷ß " * 4 + "ab×÷à " * 9)]


@pytest.mark.parametrize(("seed", "alphabet", "group"), [(1, "ab", 6), (2, "abé", 512), (3, "abcdefghijklmnopqrstuvwxyzßü", 8), (4, "aé", 2)])
def test_as_plain(spark, seed, alphabet, group):
    docs = corpus(seed, alphabet)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as id", "4 as key", "5 as root").repartition(5)
    got = [tuple(r) for r in spelling_variants(df, group=group).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs)


def test_one_edit():
    r = random.Random(8)
    for _ in range(4000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(6))) for _ in range(2))
        assert one_edit(a, b) == (edits(a, b) == 1)


def test_long_runs(spark):
    long = "x" * 300_000
    docs = [(1, f"{long} {long}"), (2, long), (3, f"{long}y {long}y {long}y " + "w " * 100_000), (4, "short shore shore shore short short shorts")]
    got = spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(len(r["word"]), r["n"], r["n_near"], r["form"]) for r in got if len(r["word"]) > 10} == {(300_000, 3, 1, None), (300_001, 3, 1, None)}


def test_roots(spark):
    pairs = [(f"{k:04}", f"{k + 1:04}") for k in range(37)] + [("b", "c")]
    got = {tuple(r) for r in roots(spark.createDataFrame(pairs, "word string, form string")).collect()}
    assert got == {(f"{k:04}", "0037") for k in range(37)} | {("b", "c")}


def test_sql(spark, small):
    got = Q.queries()["op11_spelling_variants"](spark, small).toPandas()
    assert not differences(got, connect(small).execute(Q.oracle_sql()["op11_spelling_variants"]).df()) and got.form.notna().any()


def test_empty(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "once")], "doc_id long, text string")).count() == 0
