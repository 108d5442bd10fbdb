"""Exact groups against a dictionary version: ties, repeated rows and ids, nulls, clashing columns; shared folders and the layout."""

import hashlib
import random
from types import SimpleNamespace

import pytest

from strandline.llm.common import shared_dir, text_batches
from strandline.llm.exact_dedup import drop_exact, exact_groups
from strandline.llm.tokens import byte_batches


def plain(rows):
    groups = {}
    for i, x in rows:
        key = "".join(c for c in x or "" if c not in " \t\n\v\f\r")
        groups.setdefault(key, []).append((i is None, -len(x or ""), i or 0, i))
    out = []
    for i, x in rows:
        key = "".join(c for c in x or "" if c not in " \t\n\v\f\r")
        keep = min(groups[key])[3]
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan_in", [2, 8])
def test_as_plain(spark, fan_in):
    r = random.Random(fan_in)
    rows = [(i, "".join(r.choice("ab \t\n é") for _ in range(r.randrange(5)))) for i in range(300)]
    rows += [(7, rows[7][1]), (7, "other"), (None, "ab"), (None, None), (900, None), (901, ""), (902, "x " * 200_000), (903, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as keep_id", "2 as group_size", "3 as run", "4 as _id", "5 as kept").repartition(9)
    got = sorted((tuple(x) for x in exact_groups(df, fan_in=fan_in).collect()), key=str)
    assert got == plain(rows)
    unique = df.dropDuplicates(["doc_id"]).where("doc_id is not null")
    out = drop_exact(unique)
    assert out.columns == df.columns
    want = plain([tuple(x)[:2] for x in unique.collect()])
    assert sorted(x["doc_id"] for x in out.collect()) == sorted(x[0] for x in want if x[3])


def test_empty(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(cluster)


def test_batches_are_bounded_by_bytes(spark):
    text_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("16m", str(16 << 20), "16777216b")
    rows = [(i, "é" * 600) for i in range(10)]
    assert [len(b) for b in byte_batches(rows, 1, 2400)] == [2] * 5
