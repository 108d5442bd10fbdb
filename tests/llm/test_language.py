"""Naive Bayes over character n-grams against a dictionary version; long texts lose nothing where they are cut."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import language as L

ALPHABETS = {"aa": "abcde fghi", "bb": "klmno pqrs", "cc": "abklé ñouy"}


def text(lang, n, r):
    return "".join(r.choice(ALPHABETS[lang]) for _ in range(n)) + r.choice(("", ".", " 12 x"))


def plain_grams(x):
    """Hashed n-grams one by one: letters stay, a run of other characters is one space, the text ends with one."""
    out, codes = Counter(), []
    for k, c in enumerate(x.lower() + "\n"):
        if c.isalpha():
            codes.append(ord(c))
        elif k == 0 or codes[-1] != 32:
            codes.append(32)
    for n in L.ORDERS:
        for k in range(len(codes) - n + 1):
            part = codes[k : k + n]
            if n > 1 or part != [32]:
                h = n
                for c in part:
                    h = (h ^ c) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                out[h % L.BUCKETS] += 1
    return out


@pytest.mark.parametrize("x", ["", "a", " ..a", "Ab, cd.", "Σας ΟΔΟΣ 12ß", "a" + " " * 300 + "b", "x\ny"])
@pytest.mark.parametrize("most", [1, 2, 3, 7, 1000])
def test_grams(x, most):
    got = Counter()
    for h in L.long_grams(x, most):
        got.update(h.tolist())
    assert got == plain_grams(x) == Counter(L.grams([x])[0].tolist())


def test_long_text_as_uncut():
    r = random.Random(1)
    matrix = np.log(np.random.default_rng(1).random((3, L.BUCKETS)) + 0.01).astype(np.float32)
    texts = [text("aa", 300_000, r), "short text", " " * 200_000 + "a", text("cc", 70_000, r)]
    for x in texts:
        got = Counter(np.concatenate([h for h, _ in L.gram_batches([x])]).tolist())
        assert got == Counter(L.grams([x])[0].tolist())
    n = [sum(plain_grams(x).values()) for x in texts[1:]]
    assert [sum(len(h) for h, _ in L.gram_batches([x])) for x in texts[1:]] == n
    assert len(L.score(texts, ["a", "b", "c"], matrix)[0]) == 4


def test_as_dictionary_version(spark):
    r = random.Random(2)
    docs = [(i, text(lang, r.randint(5, 60), r), lang if r.random() < 0.9 else None) for i in range(200) for lang in [r.choice(list(ALPHABETS))]]
    docs += [(900, None, "aa"), (901, "", "bb"), (902, "12 .", None), (None, "abc def", None), (903, "klm nop", "bb"), (903, "klm nop", "bb")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as id", "3 as cell", "4 as n").repartition(4)
    from zlib import crc32

    held = {i: crc32(str(i).encode()) % 5 == 0 for i, *_ in docs if i is not None}
    counts = {}
    for i, x, lang in docs:
        if i is not None and not held[i] and lang and x is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(x))
    langs = sorted(counts)
    total = {k: sum(c.values()) + L.SMOOTHING * L.BUCKETS for k, c in counts.items()}
    want = []
    for i, x, _ in docs:
        g = plain_grams(x or "")
        if not any(c.isalpha() for c in x or ""):
            want.append((i, "und", 0.0))
            continue
        like = [sum(n * math.log((counts[k][h] + L.SMOOTHING) / total[k]) for h, n in g.items()) for k in langs]
        best = max(like)
        want.append((i, langs[like.index(best)], 1 / sum(math.exp((v - best) / math.sqrt(sum(g.values()))) for v in like)))
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in L.identify(df).collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    for (i, apart, lang, score), (j, label, p) in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (i, lang) == (j, label) and apart == held.get(i, True)
        assert score == pytest.approx(p, rel=1e-3)
    kept = L.keep_identified(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, lang, p in want if i is None or (lang != "und" and p >= 0.5)}


def test_every_label_or_an_error(spark):
    docs = [(i, f"text {i}", f"l{i % 300:03}") for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert len(L.train(df)[0]) == 300
    with pytest.raises(ValueError, match="most_languages"):
        L.train(df, most_languages=299)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words"), (2, "12"), (3, None), (4, "")], "doc_id long, text string").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in L.identify(df).collect()} == {"und"}
    assert [r["doc_id"] for r in L.keep_identified(df).collect()] == [1]
