"""op6 and op10 against the library itself; the packed blocks against an exact round trip."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm.token_files import crc_of, pack_ids, read_index, read_tokens, unpack_ids, write_tokens
from strandline.llm.tokens import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", "  lead", "It's done,and  more.Than\n\none\tline \n x", "<|endoftext|> mid<|endoftext|>dle", "x" * 3000, "né! " * 2000, "1,234.5;a.b:c!d?e   z", "tail \n", "\n\n", " \x1c\x85y", "word " * 30000]


def rows(spark):
    texts = TEXTS + [x + " again, and again" for x in TEXTS if x]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), texts


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_long_and_odd_texts():
    """Texts of several MB, with and without spaces, and every kind of boundary, against the library."""
    import random

    from strandline.llm import tokens

    t, enc, r = library(), tokens.encoder(PATH), random.Random(3)
    signs = " \n\t\r  abcXYZ019'.,;:!?-_\"()<|>\x1c\x85\xa0é漢　ß٣²\u2003\x00\x7f"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(3000)]
    bits = ["'s", "'ll", " ", "  ", "\n", "a", "1", "don't", "''s", "<|endoftext|>", "é", " é", "\xa0", "!'s"]
    texts += ["".join(r.choice(bits) for _ in range(r.randrange(20))) for _ in range(3000)]
    texts += ["ab1" * 1_700_000, "日本語" * 40_000, "x" * 200_000, "word, " * 400_000, "\n" * 3000]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(2):  # with and without what is remembered
        ids, n = enc.of([x.encode() for x in texts])
        assert n.tolist() == list(map(len, want))
        assert (ids == np.concatenate([np.array(x, np.uint32) for x in want])).all()
    assert sum(map(len, tokens.parts(b"ab1" * 1_700_000))) == 5_100_000


def test_crc_of_parts():
    r = np.random.default_rng(1)
    parts = [r.bytes(int(n)) for n in r.integers(0, 100_000, 40)]
    assert crc_of([(len(x), zlib.crc32(x)) for x in parts]) == zlib.crc32(b"".join(parts))


def test_unbalanced_ids(spark):
    """Most ids are one, some are null, one text is in many segments: the files' order is that of the ids."""
    rows = [(7, f"text {i % 3} " * (i % 5)) for i in range(300)] + [(None, "none")] * 5 + [(8, "a1 " * 300_000), (-4, "x"), (10**12, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("id", F.lit("x")).repartition(5)
    t = library()
    got = sorted((r["start"], r["n_tokens"], r["doc_id"], r["ids_crc32"]) for r in read_index(spark, write_tokens(df, PATH, shard_bytes=4000)).collect())
    at = 0
    for start, n, *_ in got:
        assert start == at
        at += n
    ids = [r[2] for r in got]
    assert ids == [None] * 5 + [-4] + [7] * 300 + [8, 10**12]
    want = sorted((i or 0, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, x in rows)
    assert sorted((r[2] or 0, r[3]) for r in got) == want


def test_counts(spark):
    df, texts = rows(spark)
    t = library()
    want = {(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)}
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(df, PATH).collect()} == want
    assert token_counts(df.limit(0), PATH).count() == 0


def test_files(spark):
    df, texts = rows(spark)
    t, want, at = library(), [], 0
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    folder = write_tokens(df, PATH, shard_bytes=40_000)
    assert sorted(tuple(r) for r in read_index(spark, folder).collect()) == want
    assert sum(len(r["ids"]) for r in read_tokens(spark, folder).collect()) == at
    empty = write_tokens(df.limit(0), PATH)
    assert read_index(spark, empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**32 - 1])
def test_round_trip(n, top):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.05, r.integers(0, top, n), r.integers(0, min(top, 40), n)).astype(np.uint32)
    assert (unpack_ids(pack_ids(ids)) == ids).all()
