"""Near-duplicate embeddings against all pairs in double precision: odd vectors, copies, blocks, bounds and their recall."""

import math

import numpy as np
import pytest

from strandline.llm.embeddings import candidates, encode, link_embeddings, rotation

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=260, dim=12, seed=1):
    r = np.random.default_rng(seed)
    out, base = [], r.standard_normal((30, dim))
    for i in range(n):
        v = base[r.integers(30)] + r.standard_normal(dim) * r.choice([0, 0.1, 0.25, 0.35])
        out.append((i * 2, [float(x) for x in np.float32(v * r.choice([1, 3.5]))], int(r.integers(2))))
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [1.0, 2.0]]
    out += [(9000 + k, v, 0) for k, v in enumerate(odd)] + [(9100, out[0][1], None), (9101, [1.0, 2.0], 0), (9102, [2.0, 4.0], 0), (9103, [1.0, 2.0], 1)]
    return out


def brute(rows, least=0.93):
    good = {i: np.float64(v) for i, v, label in rows if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    label = {i: x for i, _, x in rows}
    n, root, ids = {i: 0 for i in label}, {i: i for i in label}, sorted(good)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            u, v = good[a], good[b]
            if label[a] == label[b] and len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= least:
                n[a], n[b] = n[a] + 1, n[b] + 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, n[i], find(i), find(i) == i) for i in label}


@pytest.mark.parametrize("block", [16, 2048])
def test_as_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as copies", "4 as rep").repartition(5)
    assert {tuple(r) for r in link_embeddings(df, block=block).collect()} == brute(rows)


def test_empty_and_repeated_ids(spark):
    assert link_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    got = link_embeddings(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)], SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)


def test_repeated_ids_with_other_vectors(spark):
    """Rows of one id are vectors of their own: each row is given a number, compared by it, and takes the smallest id of the rows it reaches."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.02], 0)]
    got = sorted(tuple(r) for r in link_embeddings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]
    rows = [(i // 3, *rest) for i, *rest in vectors(120)[:120]] + [(None, [1.0] * 12, 0)]
    numbered = brute([(k, v, x) for k, (i, v, x) in enumerate(rows) if i is not None])
    at = {k: root for k, _, root, _ in numbered}
    least = {}
    for k, root in at.items():
        least[root] = min(least.get(root, 10**9), rows[k][0])
    want = [(rows[k][0], n, least[at[k]], rows[k][0] == least[at[k]]) for k, n, *_ in numbered] + [(None, 0, None, True)]
    got = [tuple(r) for r in link_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(3), block=16).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_bounds_lose_nothing_and_decide_most(dim):
    r = np.random.default_rng(dim)
    base = r.standard_normal((40, dim))
    v = np.repeat(base, 25, axis=0) + r.standard_normal((1000, dim)) * r.choice([0.05, 0.2, 0.3, 0.6], (1000, 1))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    codes, factor = encode(unit)
    turned = unit @ rotation(dim)
    link = unit @ unit.T >= 0.93
    found = candidates(codes, factor, turned, 0.93, 6.0)
    assert not (link & ~found).any()  # recall 1
    assert found.mean() < 0.2
    estimate = (np.unpackbits(codes, axis=1, count=dim) * 2.0 - 1) @ turned.T / math.sqrt(dim) / factor[:, None]
    off = (estimate - unit @ unit.T)[~np.eye(1000, dtype=bool)]
    assert abs(off.mean()) < 0.01  # unbiased
    if dim > 64:
        assert found.sum() < candidates(codes, factor, turned, 0.93, None).sum()
