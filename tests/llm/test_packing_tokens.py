"""Sequence lengths in tokens: op7 and the packing stage against the library's counts."""

import random

import pytest

import corpus_pipeline
from strandline.llm import queries as Q
from strandline.llm.packing import CAPACITIES

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(got, want):
    held, covered = {}, {}
    for r in got:
        held.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_start"], r["size"]))
        covered.setdefault(r["doc_id"], []).append((r["piece"], r["doc_start"], r["size"]))
    assert {i: sum(x[2] for x in p) for i, p in covered.items()} == want
    for parts in covered.values():
        at = 0
        for k, (piece, start, size) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at)
            at += size
    for (_, capacity), parts in held.items():
        end = 0
        for start, size in sorted(parts):
            assert start == end
            end += size
        assert end <= capacity == min(c for c in CAPACITIES if c >= end)


@pytest.mark.parametrize("query", [True, False])
def test_sizes_are_tokens(spark, tmp_path, query):
    from tokenizers import Tokenizer

    r = random.Random(4)
    # An unspaced script, a blob of base64 and minified code are one word each and many tokens.
    texts = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(6000)), "".join(r.choice("ABCDEFabcdef0123456789+/") for _ in range(20_000)), "a=b;c(d);" * 3000, "plain words, and some more. " * 40, "", None, " \n"]
    texts += ["".join(chr(r.randrange(0x3041, 0x3090)) for _ in range(r.randrange(1, 400))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(PATH)
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert max(want.values()) > max(CAPACITIES)
    got = Q.op7_best_fit_packing(spark, str(tmp_path)) if query else corpus_pipeline.packing(spark, docs, str(tmp_path))
    check([x.asDict() for x in got.collect()], want)


def plain_pack(sizes, capacities):
    """Variable-capacity best fit, read off its description: a list of bins, searched in full for every piece."""
    from strandline.llm.packing import cost

    bins, out = [], []
    for k, size in enumerate(sizes):
        fits = [b for b in bins if b[0] - b[1] >= size]
        if fits:
            least = min(b[0] - b[1] for b in fits)
            b = [b for b in fits if b[0] - b[1] == least]
            b = max(b, key=lambda b: b[2])  # of equal rooms, the one touched last
        else:
            best = None
            for c in sorted(capacities):
                if c >= size:
                    room, fill = c - size, 0
                    for s in sorted((s for s in sizes[k + 1 :] if s <= min(room, size)), reverse=True):
                        fill += s
                    each = cost(c) / max(1, size + min(room, fill))
                    if best is None or each < best[0]:
                        best = (each, c)
            b = [best[1], 0, 0, len(bins)]
            bins.append(b)
        out.append((b[3], b[1]))
        b[1] += size
        b[2] = k + 1
    return out, [min(c for c in capacities if c >= b[1]) for b in bins]


@pytest.mark.parametrize("seed", range(6))
def test_pack_as_plain_best_fit(seed):
    from strandline.llm.packing import pack

    r = random.Random(seed)
    capacities = (8, 16, 32, 64)
    sizes = sorted((r.choice((0, 1, 2, 3, 5, 9, 17, 33, 64, r.randint(0, 64))) for _ in range(200)), reverse=True)
    bins, offsets, caps = pack(sizes, capacities)
    want, downsized = plain_pack(sizes, capacities)
    assert list(zip(bins, offsets)) == want and caps == downsized


def test_pack_is_near_the_best_split():
    """On small inputs, its cost against the least over all ways to share pieces among bins."""
    from strandline.llm.packing import cost, pack

    def splits(items, bins=()):
        if not items:
            yield bins
            return
        for k in range(len(bins)):
            if bins[k] + items[0] <= 64:
                yield from splits(items[1:], bins[:k] + (bins[k] + items[0],) + bins[k + 1 :])
        yield from splits(items[1:], (*bins, items[0]))

    r, capacities, ratio = random.Random(1), (8, 16, 32, 64), []
    need = lambda used: cost(next(c for c in capacities if c >= used))
    for _ in range(25):
        sizes = sorted((r.randint(1, 64) for _ in range(7)), reverse=True)
        least = min(sum(map(need, b)) for b in splits(tuple(sizes)))
        ratio.append(sum(map(cost, pack(sizes, capacities)[2])) / least)
    assert sum(ratio) / len(ratio) < 1.1 and max(ratio) < 1.5


def test_rows_without_an_id_are_spread(spark):
    from strandline.llm.packing import pack_documents

    docs = spark.createDataFrame([(None, "one two three")] * 900 + [(k, "one two") for k in range(100)], "doc_id long, text string").repartition(4)
    got = pack_documents(docs, shard=100).collect()
    shards = [r["bin_id"].split("-")[0] for r in got if r["doc_id"] is None]
    assert len(shards) == 900 and max(map(shards.count, set(shards))) < 250 and sum(r["size"] for r in got) == 2900
