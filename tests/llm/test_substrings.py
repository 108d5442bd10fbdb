"""op5 against a brute-force version: every byte in a 50-byte string that also starts in a smaller document goes."""

import hashlib
import random
import subprocess
import sys
from pathlib import Path

import pytest

from strandline.llm.substrings import CHUNK, LENGTH, repeated_bytes


def brute(rows):
    seen = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, x in texts:
        for s in range(len(x) - LENGTH + 1):
            g = x[s : s + LENGTH]
            seen[g] = min(seen.get(g, i), i)
    out = set()
    for i, x in texts:
        gone = bytearray(len(x))
        for s in range(len(x) - LENGTH + 1):
            if seen[x[s : s + LENGTH]] < i:
                gone[s : s + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for k in range(len(x)) if gone[k] and not (k and gone[k - 1]))
        out.add((i, len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    return out


def corpus(seed: int, n: int = 60):
    r = random.Random(seed)
    parts = ["".join(r.choice("abcdeé \n") for _ in range(r.choice((10, 60, 130)))) for _ in range(25)] + ["x" * 200, "ab" * 90]
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.7 else str(r.random()) for _ in range(r.randint(0, 9)))) for i in r.sample(range(-50, 1000), n)]
    return rows + [(2000, None), (2001, ""), (2002, rows[0][1]), (2003, "y" * 49), (2004, "y" * 49), (2005, "z" * 5000), (2006, "z" * 5000)]


@pytest.mark.parametrize("seed,hot", [(1, 1 << 12), (2, 0), (3, 5)])
def test_as_brute_force(spark, seed, hot):
    rows = corpus(seed)
    r = random.Random(seed)
    rows += [(3000 + i, "".join(r.choice("pq") for _ in range(9)) + "one passage that very many of the documents have in common, but not what is about it" + str(r.random())[: i % 7]) for i in range(80)]
    got = repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bucket_bytes=64, hot=hot)
    assert {tuple(r)[:5] for r in got.collect()} == brute(rows)


@pytest.mark.parametrize("hot", [1 << 12, 0])
def test_repeated_ids(spark, hot):
    """Rows of one id, with equal and with other texts, don't match each other, and each is marked by itself."""
    rows = [(i // 3, x) for i, x in corpus(7) if i < 2000]
    rows += [(1, "L" * 200 + "q" * 100), (2, "M" * 300), (2, "L" * 200 + "q" * 100), (3, "M" * 300), (2, "M" * 300), (5000, "own " * 90), (5000, "own " * 90), (5000, "M" * 60 + "own " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as tag", "3 as units", "4 as bucket", "5 as maybe").repartition(4)
    got = sorted(tuple(r)[:5] for r in repeated_bytes(df, bucket_bytes=64, hot=hot).collect())
    assert got == sorted(plain(rows)) and len([g for g in got if g[0] == 2 and g[2] == 0]) >= 2


def plain(rows):
    """As brute, row by row: a list."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, x in texts:
        for s in range(len(x) - LENGTH + 1):
            least[x[s : s + LENGTH]] = min(least.get(x[s : s + LENGTH], i), i)
    for i, x in texts:
        gone = [False] * len(x)
        for s in range(len(x) - LENGTH + 1):
            if least[x[s : s + LENGTH]] < i:
                gone[s : s + LENGTH] = [True] * LENGTH
        kept = bytes(c for c, g in zip(x, gone) if not g)
        yield i, len(x), sum(gone), sum(g and not h for g, h in zip(gone, [False, *gone])), hashlib.sha256(kept).hexdigest()


def test_long_texts_are_worked_on_in_parts(spark):
    """Texts of several CHUNKs with passages across their edges; and the memory of one of 50 MB."""
    r = random.Random(3)
    noise = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage = noise(400)
    first = noise(CHUNK - 130) + passage + noise(CHUNK - 600) + passage + "z" * 3000
    rows = [(1, "z" * 70 + passage[100:]), (2, first), (3, first[CHUNK - 200 :] + noise(300)), (4, noise(90) + passage)]
    got = repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert {tuple(x)[:5] for x in got.collect()} == set(plain(rows))


def test_memory_of_a_long_text():
    code = """
import resource, numpy as np
from strandline.llm.substrings import units_of, _cut
text = np.random.default_rng(1).integers(97, 123, 50_000_000).astype(np.uint8).tobytes()
before, told = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, []
for u in units_of([text]):
    told.append(u.at[::3] * 4)
told = np.concatenate(told)
assert _cut([(1, text, told, None, None)])["n_removed"][0].as_py() > 10_000_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=Path(__file__).resolve().parents[2])
    assert int(out.stdout) < 1_000_000, out  # kilobytes


def test_empty_and_null_ids(spark):
    assert repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "q" * 80), (3, "q" * 80), (4, "q" * 80)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in repeated_bytes(rows).collect()} == {(None, 0), (3, 0), (4, 80)}
