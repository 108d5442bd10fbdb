"""Every stage of the pipeline against a plain version of itself on what its predecessor kept, and run() as a whole."""

import random
from collections import Counter, defaultdict

import pytest
from compare import connect
from test_language import plain_grams
from test_operators import components
from test_packing_tokens import PATH, check

import corpus_pipeline as P
from strandline.llm import language as L
from strandline.llm import queries as Q

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "copies", "id", "component", "kept", "size"]


def corpus():
    r = random.Random(8)
    words = {"en": ["the", "house", "with", "water", "and", "bright", "tower", "which"], "fr": ["maison", "avec", "été", "où", "forêt", "près", "garçon", "eau"]}
    rows = []
    for i in range(150):
        lang = r.choice(["en", "fr"])
        if rows and r.random() < 0.35:
            base = r.choice(rows)
            lang, x = base[2], (base[1] or "").split(" ")
            if r.random() < 0.6:
                x[r.randrange(len(x))] = r.choice(words["en"])
            text = ("  " if r.random() < 0.3 else " ").join(x)
        else:
            text = " ".join(r.choice(words[lang]) for _ in range(r.choice((2, 6, 30, 120))))
        rows.append((i, text, lang if r.random() < 0.9 else None, r.choice(("a", "a", "b", None)), len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, "12 34", "fr", None, 5), (903, "the house " * 20_000, None, "b", None)]
    return [(*x, 1, 2, 3, True, 4) for x in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    schema = "doc_id long, text string, lang string, source string, n_chars int, copies int, id int, component int, kept boolean, size int"
    spark.createDataFrame(corpus(), schema).repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


def plain_language(rows):
    import math
    from zlib import crc32

    counts = defaultdict(Counter)
    for d in rows:
        if crc32(str(d[0]).encode()) % 5 and d[2] and d[1] is not None:
            counts[d[2]].update(plain_grams(d[1]))
    total = {k: sum(c.values()) + L.SMOOTHING * L.BUCKETS for k, c in counts.items()}
    out = set()
    for d in rows:
        if any(c.isalpha() for c in d[1] or ""):
            g = plain_grams(d[1])
            like = [sum(n * math.log((counts[k][h] + L.SMOOTHING) / total[k]) for h, n in g.items()) for k in sorted(counts)]
            if 1 / sum(math.exp((v - max(like)) / math.sqrt(sum(g.values()))) for v in like) >= 0.5:
                out.add(d[0])
    return out


def plain_exact(rows):
    best = {}
    for d in rows:
        key = "".join(c for c in d[1] or "" if c not in " \t\n\v\f\r")
        best[key] = min(best.get(key, (1, 0)), (-len(d[1] or ""), d[0]))
    return {i for _, i in best.values()}


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    for name, stage in P.STAGES[:3]:
        out = stage(spark, docs, folder)
        assert out.columns == COLUMNS
        plain = {"language_id": plain_language, "exact_dedup": plain_exact, "near_dedup": lambda rows: {i for i, _, c in components(rows) if i == c}}[name]
        want = plain(rows)
        got = [tuple(r) for r in out.collect()]
        assert len(want) < len(rows) and sorted(x[0] for x in got) == sorted(want), name
        assert set(got) <= set(rows)
        docs, rows = spark.createDataFrame(got, docs.schema), got
    docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    copies = connect(str(tmp_path)).execute(Q.oracle_sql()["op3_mixing"]).df()
    want = {int(i): int(c) for i, c in zip(copies.doc_id, copies.copies) if c}
    mixed = P.mixing(spark, docs, folder)
    got = [tuple(r) for r in mixed.collect()]
    assert mixed.columns == COLUMNS and Counter(x[0] for x in got) == want and set(got) <= set(rows)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    tokens = {x[0]: len(t.encode(x[1], add_special_tokens=False).ids) for x in rows}
    packed = [r.asDict() for r in P.packing(spark, spark.createDataFrame(rows, docs.schema), folder).collect()]
    check(packed, tokens)


def test_run(spark, folder):
    out = P.run(spark, folder).collect()
    assert out and {"doc_id", "bin_id", "capacity", "size"} <= set(out[0].asDict())
    assert 903 in {r["doc_id"] for r in out} and not {900, 901, 902} & {r["doc_id"] for r in out}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
