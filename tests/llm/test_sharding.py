"""K-d sharding against a recursive version in plain Python: hot groups of copies, nulls, repeated rows, one document above the target, empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from compare import connect, differences

from strandline.llm import queries as Q
from strandline.llm.sharding import kd_shards, write_shards


def hexed(x, digits):
    return int(hashlib.md5(x.encode()).hexdigest()[:digits], 16)


def plain(docs, shards, whole=0.01):
    pts, groups = [], defaultdict(list)
    for i, x, source, lang in docs:
        raw, name = (x or "").encode(), "null" if i is None else str(i)
        digest, size = hashlib.md5(raw).hexdigest(), len(raw) + 1
        k = size.bit_length() - 1
        pts.append({"id": i, "size": size, "crc": zlib.crc32(raw), "tie": int(digest[:8], 16), "pick": hexed(name, 8), "seat": hexed(f"{name}:{digest}", 8), "g": (digest, size),
                    "c": [*(0 if v is None else hexed(v, 4) + 1 for v in (source, lang)), k * 1024 + size * 1024 // 2**k - 1024]})
        groups[digest, size].append(pts[-1])
    for g in groups.values():
        least = [min(p["c"][k] for p in g) for k in range(3)]
        for p in g:
            p["c"] = least
    if not pts:
        return []
    widest = [max(max(p["c"][k] for p in pts) - min(p["c"][k] for p in pts), 1) for k in range(3)]

    def cut(rows, low, high):
        if high - low < 2 or not rows:
            for p in rows:
                p["shard"] = low
            return
        width = [(max(p["c"][k] for p in rows) - min(p["c"][k] for p in rows)) / widest[k] for k in range(3)]
        dim, mid, total = width.index(max(width)), low + (high - low) // 2, sum(p["size"] for p in rows)
        goal = total * (mid - low) / (high - low)

        def side(rows, key, before):
            """(left, right, in question, bytes before what is in question)"""
            w = Counter()
            for p in rows:
                w[key(p)] += p["size"]
            for k in sorted(w):
                if before + w[k] > goal:
                    return [p for p in rows if key(p) < k], [p for p in rows if key(p) > k], [p for p in rows if key(p) == k], before
                before += w[k]

        left, right, tied, before = side(rows, lambda p: (p["c"][dim], p["tie"]), 0)
        if sum(p["size"] for p in tied) > total * whole:
            a, b, tied, before = side(tied, lambda p: p["pick"], before)
            left, right = left + a, right + b
        if goal - before >= sum(p["size"] for p in tied) / 2:
            left = left + tied
        else:
            right = right + tied
        cut(left, low, mid)
        cut(right, mid, high)

    cut(pts, 0, shards)
    out, slots = [], Counter()
    for p in sorted(pts, key=lambda p: (p["shard"], p["seat"], p["id"] is not None, p["id"] or 0)):
        out.append((p["id"], p["size"], p["crc"], "bytes", p["shard"], slots[p["shard"]], None))
        slots[p["shard"]] += 1
    return out


SCHEMA = "doc_id long, text string, source string, lang string"


def corpus(seed, n=400):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        x = "hot copy of a text" if r.random() < 0.34 else "é" * r.choice((1, 10, 100, 1000)) + str(r.randrange(n))
        docs.append((i * 3, x, r.choice(("a", "a", "a", "b", "c", None)), r.choice(("en", "fr", None))))
    return docs + [(None, None, None, None), (None, "", "a", "en"), (3, docs[1][1], *docs[1][2:]), (3, "other", "b", None), (9000, "long " * 200_000, "b", "fr")]


@pytest.mark.parametrize(("seed", "shards"), [(1, 8), (2, 5), (3, 1)])
def test_as_plain(spark, seed, shards):
    docs = corpus(seed)[: -1 if seed == 1 else None]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as shard", "2 as low", "'x' as id", "3 as size", "4 as tie", "5 as c0", "6 as digest").repartition(5)
    got = sorted((tuple(r) for r in kd_shards(df, shards).collect()), key=str)
    assert got == sorted(plain(docs, shards), key=str)
    if seed == 1:
        load = Counter()
        for _, size, *_, shard, _, _ in got:
            load[shard] += size
        assert max(load.values()) < 1.05 * sum(load.values()) / 8


def test_copies_share_a_shard(spark):
    docs = [(i, f"text {i % 300} " * (1 + i % 7), "ab"[i % 2], None) for i in range(1200)]
    got = kd_shards(spark.createDataFrame(docs, SCHEMA)).groupBy("text_crc32").agg({"shard": "min", "*": "count"}).count()
    parts = kd_shards(spark.createDataFrame(docs, SCHEMA)).select("text_crc32", "shard").distinct().count()
    assert got == parts


def test_sql(spark, small):
    got = Q.queries()["op12_sharding"](spark, small).toPandas()
    assert not differences(got, connect(small).execute(Q.oracle_sql()["op12_sharding"]).df())


def test_numbers_and_targets(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 50), float(i % 13) if i % 5 else None, i) for i in range(1000)], "doc_id long, text string, score double, rank int")
    told = kd_shards(df, dims=("score", "rank"), target_bytes=2000)
    load = {r["shard"]: r["b"] for r in told.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()}
    assert len(load) == 13 and max(load.values()) < 2300
    write_shards(df, f"{tmp_path}/out", dims=("score", "rank"), target_bytes=2000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {tuple(r) for r in back.drop("_shard").collect()} == {tuple(r) for r in df.collect()} and back.select("_shard").distinct().count() == 13


def test_empty(spark):
    assert kd_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in kd_shards(spark.createDataFrame([(1, None, None, None)], SCHEMA)).collect()] == plain([(1, None, None, None)], 8)
