"""Token-ID files of patched frame-of-reference blocks.

A set of token files is a folder of Parquet files that Spark writes and commits. A row is a segment, at most SEGMENT ids in
the order of the stream: shard, segment, first_id (ids of the shard before it), n_ids, payload, docs. A payload holds blocks of
BLOCK ids. Each block is its minimum, a width in bits that CHOSEN of its 100 offsets fit, the offsets packed at that
width, and a list of exceptions (place and high part) for the rest. The payload starts with the index of where its blocks
start, so an id can be read without those before it. docs lists the documents that lie in the segment, whole or in part: id, place
(rank in the shard), at (ids of the shard before it), n_tokens.

The shards are ranges of doc_id in ascending order, of about SHARD_BYTES of text each, so there is no most of them; their starts in
the whole stream are sums over the shards. Texts are shuffled once, by range, and are encoded where they are sorted, so ids never are.

Defined results: ids are integers (others are cast, and null where they can't be); null text is empty and has the end id only; a null id
comes first and has its row in the index as any other; rows that repeat an id follow each other by their texts' hashes; an empty
table gives empty files; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fit_broadcast, shared_dir, text_batches, text_of, written
from .tokens import byte_batches, encoder, rows_of

BLOCK, SEGMENT, CHOSEN = 128, 1 << 16, 90
END = 0
SHARD_BYTES = 64 << 20
SCHEMA = "shard int, segment long, first_id long, n_ids long, payload binary, docs array<struct<id:long,place:long,at:long,n_tokens:long>>"
DOCS = pa.list_(pa.struct([(x, pa.int64()) for x in ("id", "place", "at", "n_tokens")]))


def pack_ids(ids: np.ndarray) -> bytes:
    """A segment: number of ids and blocks, index of block starts, blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1] if n else 0)]).astype(np.uint32).reshape(-1, BLOCK)
    least = full.min(axis=1) if n else np.zeros(0, np.uint32)
    offset = full - least[:, None]
    ranked = np.sort(offset, axis=1)[:, (BLOCK * CHOSEN + 99) // 100 - 1] if n else least
    width = np.ceil(np.log2(ranked.astype(np.float64) + 1)).astype(np.uint8)
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():  # all blocks of one width at once
        at = np.nonzero(width == w)[0]
        bits = np.unpackbits(np.ascontiguousarray(offset[at].astype("<u4")).view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        raw, size = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little").tobytes(), BLOCK * w // 8
        for j, k in enumerate(at.tolist()):
            body[k] = raw[j * size : (j + 1) * size]
    high = np.where(width[:, None] < 32, offset >> np.minimum(width, 31)[:, None], 0).astype(np.uint32)
    block, place = np.nonzero(high)
    odd, over = place.astype(np.uint8).tobytes(), high[block, place].tobytes()
    edge = np.searchsorted(block, np.arange(blocks + 1))
    head = np.zeros((blocks, 6), np.uint8)
    head[:, :4], head[:, 4], head[:, 5] = least.astype("<u4").view(np.uint8).reshape(-1, 4), width, np.diff(edge)
    heads, edge = head.tobytes(), edge.tolist()
    out = [b"".join((heads[6 * k : 6 * k + 6], body[k], odd[e:f], over[4 * e : 4 * f])) for k, (e, f) in enumerate(zip(edge, edge[1:]))]
    starts = np.cumsum([0, *map(len, out)])[:-1]
    return np.array([n, blocks, *starts.tolist()], np.uint32).tobytes() + b"".join(out)


def unpack_ids(payload: bytes) -> np.ndarray:
    n, blocks = np.frombuffer(payload, np.uint32, 2).tolist()
    start = np.frombuffer(payload, np.uint32, blocks, 8).astype(np.int64) + 8 + 4 * blocks
    raw, out = np.frombuffer(payload, np.uint8), np.zeros((blocks, BLOCK), np.uint32)
    width, count = raw[start + 4].astype(np.int64), raw[start + 5].astype(np.int64)
    for w in np.unique(width).tolist():
        at = np.nonzero(width == w)[0]
        if w:
            bits = np.zeros((len(at), BLOCK, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(raw[(start[at] + 6)[:, None] + np.arange(BLOCK * w // 8)], axis=1, bitorder="little").reshape(-1, BLOCK, w)
            out[at] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    block = np.repeat(np.arange(blocks), count)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    lists = (start + 6 + BLOCK * width // 8)[block]
    high = raw[(lists + count[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if len(block) else np.zeros(0, np.uint32)
    out[block, raw[lists + nth]] |= high << width[block].astype(np.uint32)
    out += raw[start[:, None] + np.arange(4)].copy().view("<u4")
    return out.reshape(-1)[:n]


def _with_end(ids: np.ndarray, count: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some documents with the end id after each, and how many each has then."""
    out, count = np.full(len(ids) + len(count), end, np.uint32), count + 1
    own = np.ones(len(out), bool)
    own[np.cumsum(count) - 1] = False
    out[own] = ids
    return out, count


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES, end: int = END) -> str:
    """Writes the files of df's documents, encoded with the tokenizer file at path, and returns their folder."""
    spark = df.sparkSession
    text_batches(spark)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    total = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    # Small tables are dealt over a few times the cores, as long as a shard has a hundredth of SHARD_BYTES.
    shards = max(1, total // shard_bytes, min(4 * spark.sparkContext.defaultParallelism, 100 * total // shard_bytes))
    source = df.select(F.col(id_col).cast("long").alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    # Rows that repeat an id, or have none, are in the order of their texts' hashes, so that they need not be in one shard.
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = source.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id()).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]):
        enc = encoder(path)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), DOCS]
        held, size, first, segment, total, place, shard = [], 0, 0, 0, 0, 0, 0
        docs = [np.zeros(0, np.int64)] * 3  # place, at and n_tokens of the documents that are not all written; ids_left: their ids
        ids_left: list = []

        def segments(least: int):
            """Rows of the full segments (least: SEGMENT) or of all that is held (1)."""
            nonlocal held, size, first, segment, docs, ids_left
            x, k = np.concatenate(held) if held else np.zeros(0, np.uint32), 0
            place_, at, n = docs
            while size - k >= least:
                part = x[k : k + SEGMENT]
                lo, hi = np.searchsorted(at + n, first, side="right"), np.searchsorted(at, first + len(part))
                here = [dict(zip(("id", "place", "at", "n_tokens"), d)) for d in zip(ids_left[lo:hi], place_[lo:hi].tolist(), at[lo:hi].tolist(), n[lo:hi].tolist())]
                yield shard, segment, first, len(part), pack_ids(part), here
                segment, first, k = segment + 1, first + len(part), k + len(part)
            held, size = [x[k:]], size - k
            lo = np.searchsorted(at + n, first, side="right")
            docs, ids_left = [c[lo:] for c in docs], ids_left[lo:]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "segment", "first_id", "n_ids", "payload", "docs"])

        for part in byte_batches(rows_of(batches), 1):
            shard = part[0][2]
            ids, n = _with_end(*enc.of([r[1] for r in part]), end)
            held.append(ids)
            size += len(ids)
            docs = [np.concatenate(c) for c in zip(docs, (np.arange(place, place + len(n)), total + np.cumsum(n) - n, n))]
            ids_left += [r[0] for r in part]
            place, total = place + len(n), total + len(ids)
            if rows := list(segments(SEGMENT)):
                yield batch(rows)
        if rows := list(segments(1)):
            yield batch(rows)

    dealt.mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(folder)
    return folder


def shard_starts(shards: DataFrame, many: int = 1000) -> DataFrame:
    """(shard, n) -> shard, before: the sum of the n of smaller shards, by groups of so many shards and then within each."""
    sums = shards.withColumn("group", F.floor(F.col("shard") / many))
    groups = sums.groupBy("group").agg(F.sum("n").alias("all"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", F.coalesce(F.sum("all").over(earlier(Window.orderBy("group"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("group").orderBy("shard"))), F.lit(0))
    return sums.withColumn("own", own).join(groups, "group").select("shard", (F.col("base") + F.col("own")).alias("before"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """shard, segment, first_id, ids of all segments: the stream in the order of (shard, segment)."""
    def run(batches):
        for b in batches:
            ids = [unpack_ids(x) for x in b["payload"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["shard"], b["segment"], b["first_id"], pa.array(ids, pa.list_(pa.int64()))], ["shard", "segment", "first_id", "ids"])

    return spark.read.schema(SCHEMA).parquet(folder).select("shard", "segment", "first_id", "payload").mapInArrow(run, "shard int, segment long, first_id long, ids array<long>")


def read_index(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document, from the files: id_col, start (ids before it), n_tokens, ids_crc32.

    A segment's documents are cut out of it where it is decoded. The checks of the parts of a document in several segments are joined in order.
    """
    files = spark.read.schema(SCHEMA).parquet(folder)
    before = written(shard_starts(files.groupBy("shard").agg(F.sum("n_ids").alias("n"))))

    def run(batches):
        names = ["shard", "place", "id", "at", "n_tokens", "segment", "n", "crc"]
        kinds = [pa.int32()] + [pa.int64()] * 7
        for shard, segment, first, payload, docs in rows_of(batches):
            ids, rows = unpack_ids(payload), []
            for d in docs:
                a, b = max(0, d["at"] - first), min(len(ids), d["at"] + d["n_tokens"] - first)
                rows.append((shard, d["place"], d["id"], d["at"], d["n_tokens"], segment, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # Written, so that the files are decoded once: few numbers for each document.
    checked = written(files.select("shard", "segment", "first_id", "payload", "docs").mapInArrow(run, "shard int, place long, id long, at long, n_tokens long, segment long, n long, crc long"))
    checked = checked.join(fit_broadcast(before), "shard").withColumn("start", F.col("before") + F.col("at"))
    whole = checked.where("n = n_tokens").select(F.col("id").alias(id_col), "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    cut = checked.where("n < n_tokens").groupBy("shard", "place").agg(F.first("id").alias("id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("segment", "n", "crc"))).alias("parts"))

    def join(batches):
        for b in batches:
            crc = [crc_of([(p["n"] * 4, p["crc"]) for p in x]) for x in b["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["start"], b["n_tokens"], pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return whole.unionByName(cut.select("id", "start", "n_tokens", "parts").mapInArrow(join, f"{id_col} long, start long, n_tokens long, ids_crc32 long"))


@cache
def _zeros(k: int) -> list[int]:
    """What 2**k zero bytes after it make of each bit of a crc32; -3 is one bit."""
    return [0xEDB88320] + [1 << j for j in range(31)] if k == -3 else _twice(_zeros(k - 1))


def _times(m: list[int], v: int) -> int:
    out = 0
    for x in m:
        if v & 1:
            out ^= x
        v >>= 1
    return out


def _twice(m: list[int]) -> list[int]:
    return [_times(m, x) for x in m]


def crc_of(parts: list[tuple[int, int]]) -> int:
    """The crc32 of strings joined, from the length and crc32 of each: a crc is linear over bits, so zeros are appended to the one so far by tables for powers of two."""
    out = 0
    for n, crc in parts:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _times(_zeros(k), out)
        out ^= crc
    return out
