"""The Jaccard join against all pairs: short overlapping texts at every boundary, and long lists through all their ways."""

import random

import numpy as np
import pytest
from test_operators import SCHEMA, components

from pyspark.sql import functions as F

from strandline.llm.common import maybe_in, shared_dir
from strandline.llm.jaccard import LARGEST_LIGHT, boundary, drop_near, jaccard_components, subset_keys, verified
from strandline.llm.shingles import word_hashes

PASSAGE = [f"p{i}" for i in range(60)]


def cuts(n=150, seed=1):
    """Texts of 3 to 30 words out of one passage, some with a changed word: overlaps of every size about the threshold."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = r.randint(3, 30)
        at = r.randrange(0, len(PASSAGE) - k)
        words = PASSAGE[at : at + k]
        if r.random() < 0.3:
            words[r.choice((0, -1))] = f"x{r.randrange(3)}"
        out.append((i, " ".join(words), None, None, 1))
    return out + [(900, "a b c d e f g h i", None, None, 1), (901, "b c d e f g h i j", None, None, 1), (902, "a b c d e f g h", None, None, 1)]


@pytest.mark.parametrize("light", [0, 5, LARGEST_LIGHT])
def test_short_overlaps(spark, light):
    docs = cuts(seed=light or 0)
    got = jaccard_components(spark.createDataFrame(docs, SCHEMA).repartition(4), light=light)
    assert {tuple(r) for r in got.collect()} == components(docs)


@pytest.mark.parametrize("most", range(LARGEST_LIGHT + 1))
def test_keys_link_what_links(most):
    """The stars of the subset keys against all pairs of small sets, at every boundary."""
    r = random.Random(most)
    sets = []
    for _ in range(60):
        n = r.randint(1, max(1, min(most, 11)))
        at = r.randrange(0, 12)
        sets.append(np.array(sorted(r.sample(range(at, at + n + 2), n)), np.uint64))
    stars = {}
    for i, s in enumerate(sets):
        for key in subset_keys(s, most) if len(s) <= most else []:
            stars.setdefault(key[:16], []).append((key[16], i))
    links = set()
    for members in stars.values():
        small = [i for flag, i in members if flag]
        links |= {(min(small), i) for _, i in members if small and i != min(small)}
    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
    root = list(range(len(sets)))
    want = list(range(len(sets)))

    def find(x, k):
        while x[k] != k:
            k = x[k]
        return k

    for a, b in links:
        u, v = sorted((find(root, a), find(root, b)))
        root[v] = u
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if max(len(sets[a]), len(sets[b])) <= most and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                u, v = sorted((find(want, a), find(want, b)))
                want[v] = u
    assert [find(root, k) for k in range(len(sets))] == [find(want, k) for k in range(len(sets))]


def boilerplate(seed=2):
    """Families that share most words, above and below the threshold, so that every list is long."""
    r = random.Random(seed)
    out = []
    for i in range(160):
        words = PASSAGE + [f"f{i % 7}-{k}" for k in range(r.choice((0, 3, 12, 25)))]
        if i % 3:
            words = words + [f"own{i}-{k}" for k in range(r.choice((1, 8, 18)))]
        out.append((i, " ".join(words), None, None, 1))
    return out


@pytest.mark.parametrize("most_common,rounds,long,block", [(3, 1, 2, 16), (0, 0, 1, 8)])
def test_long_lists(spark, most_common, rounds, long, block):
    docs = boilerplate() + cuts(60)[60:] + [(i + 5000, t, *x) for i, t, *x in boilerplate(4)]
    docs = [(k, *d[1:]) for k, d in enumerate(docs)]
    got = jaccard_components(spark.createDataFrame(docs, SCHEMA).repartition(3), least_common=2, most_common=most_common, rounds=rounds, long=long, block=block)
    assert {tuple(r) for r in got.collect()} == components(docs)


def test_long_text_ties_and_extra_columns(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    docs = [(1, long), (2, long + " end"), (5, "same words in this text here"), (5, "same words in this text here"), (3, "Same Words in this text here"), (None, "same words in this text here"), (9, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "'x' as e", "3 as component", "4 as component_id", "5 as rep")
    got = sorted(((r[0] is None, r[0] or 0, r[2]) for r in jaccard_components(df).collect()))
    assert [x[1:] for x in got if not x[0]] == [(1, 1), (2, 1), (3, 3), (5, 3), (5, 3), (9, 9)]
    kept = drop_near(df.where("doc_id is not null"))
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.collect()) == [1, 3, 9]


def test_boundary():
    assert boundary({}) == 0
    assert all(0 <= boundary({n: 1000}) <= LARGEST_LIGHT for n in range(1, 40))


def test_shared_folder(spark):
    assert shared_dir(spark).startswith("file:")


def test_words_of_one_pattern_do_not_collide(spark):
    """The Thue-Morse word and its complement have equal hashes under any polynomial modulo a power of two."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = word.translate({97: "b", 98: "a"})
    docs = [(1, word, None, None, 1), (2, other, None, None, 1), (3, word.upper(), None, None, 1), (4, f"{word} x y z w v", None, None, 1), (5, f"{other} x y z w v", None, None, 1)]
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 2, 4), (5, 2, 5)}


def test_word_hashes_tell_words_apart():
    r = random.Random(4)
    words = list({"".join(r.choice("ab") for _ in range(r.randrange(1, 40))) for _ in range(4000)} | {"abcdefgh" * k for k in range(1, 9)} | {"a" * k for k in range(1, 80)})
    h, start = word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))
    assert len(set(h.tolist())) == len(words) == len(start)
    again, _ = word_hashes(np.frombuffer("\n".join(w.upper() for w in words).encode(), np.uint8))
    assert (h == again).all() and not len(word_hashes(np.frombuffer(b" \n", np.uint8))[0])


@pytest.mark.parametrize("most", [16, 1 << 14])
def test_maybe_in_has_no_false_no(spark, most):
    ids = spark.range(0, 200_000, 2)
    got = maybe_in(spark.range(200_000), ids, most=most).groupBy((F.col("id") % 2).alias("odd"), "maybe").count().collect()
    n = {(r["odd"], r["maybe"]): r["count"] for r in got}
    assert n[0, True] == 100_000 and n.get((1, True), 0) < (1 if most == 16 else 20_000)


def test_an_id_in_many_pairs_is_verified_by_blocks(spark):
    sets = spark.createDataFrame([(k, list(range(k % 3, 10 + k % 3))) for k in range(50)], "id long, e array<long>")
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 50)] + [(49, k) for k in range(1, 49)], "u long, v long")
    want = {(u, v) for u, v in pairs.collect() if 100 * (10 - abs(u % 3 - v % 3)) >= 80 * (10 + abs(u % 3 - v % 3))}
    assert {tuple(r) for r in verified(pairs, sets, 80, block=4).collect()} == want
