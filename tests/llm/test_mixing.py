"""The mix: inclusion odds by length, totals near the targets, copies in bounds, nulls, ties and clashing columns."""

import random
from collections import defaultdict

from compare import connect, differences

from strandline.llm import queries as Q
from strandline.llm.mixing import TILT, mix, take_mix


def corpus(n, seed=1):
    r = random.Random(seed)
    return [(i, "w " * r.choice((1, 1, 3, 9, 40, 200, 900)), r.choice("aaaaab")) for i in range(n)]


def test_odds_by_length(spark):
    rows = corpus(6000) + [(10_000 + i, "w " * 2000, "c") for i in range(40)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    by, total = defaultdict(list), defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by[r["source"], r["size"]].append(r["copies"])
        total[r["source"]] += r["taken"]
    target = {r["source"]: r["target"] for r in got}
    for k, t in target.items():
        assert abs(total[k] - t) <= 20
    # Copies of a class go with its odds, as long as it isn't at its cap.
    mean = {size: sum(c) / len(c) for (s, size), c in by.items() if s == "a"}
    level = {size: mean[size] / (TILT + size.bit_length()) for size in mean if mean[size] < 2.9}
    assert len(level) > 1 and max(level.values()) < 1.25 * min(level.values())
    assert len({round(sum(c) / len(c), 1) for (s, _), c in by.items() if s == "a"}) > 2
    assert all(max(c) - min(c) <= 1 for c in by.values())


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "a"), (2, "", None), (3, "one two", None), (3, "one two", None), (4, " \t", "z"), (5, "x " * 100_000, "b"), (6, "a b c", ""), (7, "a b c", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = mix(df).toPandas()
    assert len(got) == len(rows) and (got[got["size"] == 0].taken == 0).all()
    unique = df.dropDuplicates(["doc_id"])
    (tmp_path / "u").mkdir()
    unique.toPandas().to_parquet(f"{tmp_path}/u/documents.parquet")
    want = connect(f"{tmp_path}/u").execute(Q.oracle_sql()["op3_mixing"]).df()
    assert not differences(Q.op3_mixing(spark, f"{tmp_path}/u").toPandas(), want)


def test_take_mix_keeps_all_columns(spark):
    df = spark.createDataFrame(corpus(50), "doc_id long, text string, source string").selectExpr("*", "1 as copies", "2 as _copy", "3 as size", "4 as _id", "5 as taken", "6 as _mix_id", "7 as `a.b`")
    out = take_mix(df)
    assert out.columns == df.columns
    want = {r["doc_id"]: r["copies"] for r in mix(df).collect() if r["copies"]}
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += 1
        assert tuple(r)[3:] == (1, 2, 3, 4, 5, 6, 7)
    assert got == want
