"""Repeated byte strings: initial buckets by 16-grams, refined by the buckets at later offsets.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller id. The initial bucket of a string
is its anchor, the least 16-gram in it (by hash); strings that are equal have equal anchors. Neighbouring strings with one anchor are a unit,
about 18 strings long, so not all positions are sent.

1. Units are dealt by anchor. An anchor in one document only is done with. A unit whose whole text is in a smaller document is
   a copy: all its strings are. What is left of anchors shared by documents with different units is open.
2. The texts of open units, about 70 bytes each, are dealt by anchor, and their buckets are refined by pointers: all positions are
   sorted by 8 bytes and numbered by bucket; buckets of 16 bytes are those of pairs (own number, number 8 later), of 32 bytes pairs of these
   (own, 16 later), and of LENGTH pairs of these (own, 18 later), so each sort reuses the numbers of the one before. Strings of a bucket
   are equal, with no hash between; those that a smaller document has too are marked. The strings of an anchor with more than
   HOT open units are dealt by a 64-bit identifier of their own in place of their texts by anchor, so a passage that many documents
   share in part is spread over all buckets.
3. Each document's marks are joined into runs.

Texts are worked on in parts of about CHUNK bytes, whatever their length, with about 50 bytes of memory for each byte of a part. Rows
go in packed batches, one for each bucket of the hash, so a frequent passage is spread over as many rows as there are batches and is
one unit in each document; no pairs are made. The texts are shuffled once, by id.

Defined results: null text is empty; shorter texts than LENGTH are kept whole and match nothing; rows with a null id are kept
whole and match nothing; rows that repeat an id are rows of their own, which match those of smaller ids and not each other (marks are kept by id
and, where an id has several texts, by a hash of the text); an empty table gives an empty result; other columns are not read, whatever
their names. Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, text_batches, text_of, written
from .shingles import mix
from .tokens import byte_batches, rows_of

LENGTH, GRAM = 50, 16
CHUNK = 1 << 19
#: Open units an anchor may have in a bucket before its strings are dealt one by one.
HOT = 1 << 12
COPY, OPEN, OFTEN = 0, 1, 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams16(raw: bytes) -> np.ndarray:
    """The identifier of the 16 bytes at each position, zeros being after the end."""
    one = np.frombuffer(raw + bytes(2 * LENGTH), np.uint8).astype(np.uint64)
    two = (one[:-1] << np.uint64(8)) | one[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = (four[:-4] << np.uint64(32)) | four[4:]
    return mix(mix(eight[:-8]) * _A + eight[8:])


def strings50(b16: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The identifiers of the LENGTH bytes at the positions s: those of 32 bytes from 16, then these from 32."""
    b32 = [mix(b16[x] * _A + b16[x + 16]) for x in (s, s + (LENGTH - 32))]
    return mix(b32[0] * _B + b32[1])


class Units:
    """The units of some parts (text, offset in it, bytes). doc: the text of each; s0, s1: first and last string, as an offset in its text; anchor, key: identifiers; at: unit number within the text, where `before` has how many each text had so far."""

    def __init__(self, parts: list[tuple[int, int, bytes]], before: dict[int, int]) -> None:
        size = np.array([len(x) for *_, x in parts], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        self.raw = b"".join(x for *_, x in parts)
        self.b16 = grams16(self.raw)
        low, at = (self.b16 >> np.uint64(32)).astype(np.uint32), np.arange(len(self.b16), dtype=np.int32)
        for step in (1, 2, 4, 8, 16, LENGTH - GRAM + 1 - 32):
            first = low[:-step] <= low[step:]
            low, at = np.where(first, low[:-step], low[step:]), np.where(first, at[:-step], at[step:])
        n = np.maximum(size - LENGTH + 1, 0)
        part = np.repeat(np.arange(len(parts)), n)
        s = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + begin[:-1][part]
        own = at[s]
        first = np.nonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])]))[0] if len(s) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:] - 1, [len(s) - 1]]) if len(s) else first
        self.part, self.from_, self.to = part[first], s[first], s[last]
        self.shift = np.array([k for _, k, _ in parts], np.int64)[self.part] - begin[:-1][self.part] if len(parts) else self.from_
        self.doc = np.array([d for d, *_ in parts], np.int64)[self.part] if len(parts) else self.from_
        self.s0, self.s1 = self.from_ + self.shift, self.to + self.shift
        self.anchor = self.b16[own[first]]
        self.key = mix(self.b50(self.from_) * _A + self.b50(self.to)) + (self.to - self.from_).astype(np.uint64)
        self.docs, self.begins, counts = np.unique(self.doc, return_index=True, return_counts=True)
        self.at = np.arange(len(self.doc)) - np.repeat(self.begins - [before.get(d, 0) for d in self.docs.tolist()], counts)
        for d, n in zip(self.docs.tolist(), counts.tolist()):
            before[d] = before.get(d, 0) + n

    def b50(self, s: np.ndarray) -> np.ndarray:
        return strings50(self.b16, s)


def units_of(texts: list[bytes]):
    """The units of the texts, about CHUNK bytes at a time."""
    before: dict[int, int] = {}
    held, size = [], 0
    for d, x in enumerate(texts):
        for k in range(0, len(x) - LENGTH + 1, CHUNK):
            held.append((d, k, x[k : k + CHUNK + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= CHUNK:
                yield Units(held, before)
                held, size = [], 0
    if held:
        yield Units(held, before)


def planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of integers, each byte's plane by itself, so that what is alike lies together for compression."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unplanes(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(x) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(x, np.uint8).reshape(n, -1).T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def deal(hash_: np.ndarray, buckets: int, columns: list[tuple[np.ndarray, int]]):
    """Rows (bucket, first id, packed columns) by the top bits of hash_; the first column holds ids and is packed as steps, one of width 0 is nothing where it is all zero."""
    b = (hash_ >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(hash_), np.int64)
    order = np.argsort(b, kind="stable")
    edge = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in range(buckets):
        at = order[edge[k] : edge[k + 1]]
        if len(at):
            ids = columns[0][0][at]
            yield k, int(ids[0]), planes(np.diff(ids, prepend=ids[:1]).astype(np.uint64), 8), *[planes(c[at], n or 8) if n or c[at].any() else b"" for c, n in columns[1:]]


def gathered(t: pa.Table, widths: list[int]) -> list[np.ndarray]:
    ids = [np.cumsum(unplanes(x, 8)).astype(np.int64) + f for f, x in zip(t["first"].to_pylist(), t["ids"].to_pylist())]
    out = [np.concatenate(ids)]
    for i, n in enumerate(widths):
        out.append(np.concatenate([unplanes(x, n or 8) if x else np.zeros(len(d), np.uint64) for x, d in zip(t[f"c{i}"].to_pylist(), ids)]))
    return out


def _edges(*cols: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one before."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _runs(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> pa.Table:
    """The places of each document's row as runs: id, tag, starts, sizes."""
    order = np.lexsort((at, tag, doc))
    doc, tag, at = doc[order], tag[order], at[order]
    new = _edges(doc, tag, at) if len(at) else np.zeros(0, bool)  # a row that is there twice is marked twice
    doc, tag, at = doc[new], tag[new], at[new]
    first = np.nonzero(_edges(doc, tag, at - np.arange(len(at))))[0] if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(at)]]))
    doc, tag, at = doc[first], tag[first], at[first]
    row = np.nonzero(_edges(doc, tag))[0] if len(at) else first
    offsets = pa.array(np.concatenate([row, [len(at)]]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in (at, size)]
    return pa.Table.from_arrays([pa.array(doc[row]), pa.array(tag[row].view(np.int64)), *lists], names=["id", "tag", "starts", "sizes"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "first": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.binary())) for c, k in zip(zip(*rows) if rows else [[]] * len(names), names)], names)


def _tagged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tag, text: the tag is 0, but for ids with several texts a hash of the text."""
    h = F.xxhash64(F.col("text"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    several = written(rows.where("id is not null").groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").select("id"))
    if not several.take(1):
        return rows.select("id", F.lit(0).cast("long").alias("tag"), "text")
    return maybe_in(rows, several).select("id", F.when(F.col("maybe"), h).otherwise(F.lit(0)).cast("long").alias("tag"), "text")


def repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 1 << 23, hot: int = HOT) -> DataFrame:
    """One row for each row of df: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs: start and end in bytes)."""
    text_batches(df.sparkSession)
    source = _tagged(df, id_col, text_col)
    total = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = 1 << max(5, min(20, (total // bucket_bytes).bit_length()))
    keys = lambda part: (np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], np.int64).view(np.uint64))

    def send_units(batches):
        for part in byte_batches((r for r in rows_of(batches) if r[0] is not None and len(r[2]) >= LENGTH), 2, 1 << 19):
            ids, tags = keys(part)
            for u in units_of([r[2] for r in part]):
                rows = deal(u.anchor, buckets, [(ids[u.doc], 8), (tags[u.doc], 0), (u.at, 4), (u.anchor, 4), (u.key, 7)])
                yield _batch(list(rows), ["bucket", "first", "ids", "c0", "c1", "c2", "c3"])

    def refine_units(t: pa.Table) -> pa.Table:
        doc, tag, at, anchor, key = gathered(t, [0, 4, 4, 7])
        at, anchor = at.astype(np.int32), anchor.astype(np.uint32)
        # Anchors are refined in parts, so that a frequent one doesn't widen what is sorted at once beyond itself.
        parts = max(1, len(key) >> 18)
        found = [_refined(doc, at, anchor, key, np.nonzero(mix(anchor.astype(np.uint64)) % np.uint64(parts) == k)[0], hot) for k in range(parts)]
        row, kind = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_arrays([pa.array(doc[row]), pa.array(tag[row].view(np.int64)), pa.array(at[row] * np.int32(4) + kind)], names=["id", "tag", "unit"])

    packed = source.mapInArrow(send_units, "bucket int, first long, ids binary, c0 binary, c1 binary, c2 binary, c3 binary")
    # A row for each unit that counts, four times its number and its kind (COPY, OPEN, OFTEN): their number goes with the bytes, that of (document, bucket) pairs doesn't.
    told = packed.groupBy("bucket").applyInArrow(refine_units, "id long, tag long, unit int")
    told = written(told.groupBy("id", "tag").agg(F.collect_set("unit").alias("units")))
    joined = source.join(told, ["id", "tag"], "left")

    def send_strings(batches):
        rows = ((i, t, x, np.sort(np.array(u, np.int64))) for i, t, x, u in rows_of(batches) if u is not None)
        for part in byte_batches((r for r in rows if (r[3] & 3 != COPY).any()), 2, 1 << 19):
            ids, tags = keys(part)
            open_, often = ([_units(r[3], kind) for r in part] for kind in (OPEN, OFTEN))
            for u in units_of([r[2] for r in part]):
                out, pick = [], _chosen(u, open_)
                if len(pick):
                    d, first, last = u.doc[pick], u.from_[pick], u.to[pick]
                    rows = deal(u.anchor[pick], buckets, [(ids[d], 8), (tags[d], 0), (u.s0[pick], 5), (last - first + 1, 1), (u.anchor[pick], 4), (np.arange(len(pick)), 4)])
                    out += [(*r[:-1], b"".join(u.raw[first[k] : last[k] + LENGTH] for k in unplanes(r[-1], 4).astype(np.int64))) for r in rows]
                pick = _chosen(u, often)
                if len(pick):
                    n = u.to[pick] - u.from_[pick] + 1
                    unit = np.repeat(pick, n)
                    s = u.from_[unit] + np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
                    key, d = u.b50(s), u.doc[unit]
                    out += [(buckets + k, f, i, tag, at, b"", b"", x) for k, f, i, tag, at, x in deal(key, buckets, [(ids[d], 8), (tags[d], 0), (s + u.shift[unit], 5), (key, 8)])]
                yield _batch(out, ["bucket", "first", "ids", "c0", "c1", "c2", "c3", "text"])

    def refine_strings(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() >= buckets:
            (doc, tag, at), key = gathered(t, [0, 5]), np.concatenate([unplanes(x, 8) for x in t["text"].to_pylist()])
            # In parts by identifier, so that what is sorted at once stays small.
            parts = max(1, len(key) >> 19)
            picks = (np.nonzero(key % np.uint64(parts) == k)[0] for k in range(parts))
            row = np.concatenate([p[_later(key[p], doc[p])] for p in picks])
            return _runs(doc[row], tag[row], at[row].astype(np.int64))
        doc, tag, at, n, anchor = gathered(t, [0, 5, 1, 4])
        at, n = at.astype(np.int64), n.astype(np.int64)
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        data = np.frombuffer(b"".join(x.as_py() for x in t["text"]), np.uint8)
        # In parts by anchor, the initial bucket.
        parts = max(1, len(data) >> 19)
        deal_ = (mix(anchor.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(deal_, kind="stable")
        edge, found = np.searchsorted(deal_[order], np.arange(parts + 1)), []
        for k in range(parts):
            unit = order[edge[k] : edge[k + 1]]
            if len(unit):
                own, step = pointed(data, begin[unit], n[unit])
                later = _later(own, np.repeat(doc[unit], n[unit]))
                found.append((np.repeat(unit, n[unit])[later], step[later]))
        unit, step = (np.concatenate(x) for x in zip(*found))
        return _runs(doc[unit], tag[unit], at[unit] + step)

    strings = joined.mapInArrow(send_strings, "bucket int, first long, ids binary, c0 binary, c1 binary, c2 binary, c3 binary, text binary")
    marks = strings.groupBy("bucket").applyInArrow(refine_strings, "id long, tag long, starts array<int>, sizes array<int>")
    marks = marks.groupBy("id", "tag").agg(F.collect_list(F.struct("starts", "sizes")).alias("x")).select("id", "tag", F.flatten("x.starts").alias("starts"), F.flatten("x.sizes").alias("sizes"))

    def cut(batches):
        for part in byte_batches(rows_of(batches), 1, 1 << 19):
            yield _cut(part)

    out = joined.join(marks, ["id", "tag"], "left").select("id", "text", "units", "starts", "sizes")
    out = out.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def pointed(data: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For units of n strings whose texts begin at these places of data: the bucket of each string among them, and its number in its unit."""
    size = n + LENGTH - 1
    local = np.cumsum(size) - size
    text = np.concatenate([data[np.repeat(begin - local, size) + np.arange(int(size.sum()))], np.zeros(2 * LENGTH, np.uint8)])
    wide = text.astype(np.uint64)
    for k in (1, 2, 4):
        wide = (wide[:-k] << np.uint64(8 * k)) | wide[k:]
    number = np.unique(wide, return_inverse=True)[1]
    for later in (8, 16):
        pair = (number[:-later].astype(np.uint64) << np.uint64(32)) | number[later:].astype(np.uint64)
        number = np.unique(pair, return_inverse=True)[1]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    s = np.repeat(local, n) + step
    return (number[s].astype(np.uint64) << np.uint64(32)) | number[s + LENGTH - 32].astype(np.uint64), step


def _later(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of those whose key a smaller document has too."""
    order = np.lexsort((doc, key))
    d, k = doc[order], key[order]
    new = _edges(k) if len(k) else np.zeros(0, bool)
    return order[d > d[np.nonzero(new)[0]][np.cumsum(new) - 1]]


def _refined(doc: np.ndarray, at: np.ndarray, anchor: np.ndarray, key: np.ndarray, pick: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the units of pick, those that are copies of a smaller document's or open: place, kind."""
    if not len(pick):
        return pick, np.zeros(0, np.int32)
    order = pick[np.lexsort((doc[pick], key[pick], anchor[pick]))]
    doc, anchor, key = doc[order], anchor[order], key[order]
    new_anchor, new_unit = _edges(anchor), _edges(anchor, key)
    a, u = np.cumsum(new_anchor) - 1, np.cumsum(new_unit) - 1
    fa, fu = np.nonzero(new_anchor)[0], np.nonzero(new_unit)[0]
    copy = doc > doc[fu][u]
    many = np.add.reduceat(new_unit.astype(np.int32), fa)[a] > 1
    wide = np.maximum.reduceat(doc, fa) > np.minimum.reduceat(doc, fa)
    open_ = ~copy & many & wide[a]
    often = np.add.reduceat(open_.astype(np.int64), fa)[a] > hot
    say = copy | open_
    return order[say], np.where(copy, COPY, np.where(often, OFTEN, OPEN)).astype(np.int32)[say]


def _units(told: np.ndarray, kind: int) -> np.ndarray:
    """The numbers of the units of a kind, rising as told is."""
    return told[told & 3 == kind] >> 2


def _chosen(u: Units, wanted: list[np.ndarray]) -> np.ndarray:
    """Places in u of the unit numbers wanted of each text, as far as u has them."""
    out = [np.zeros(0, np.int64)]
    for d, begin, end in zip(u.docs.tolist(), u.begins.tolist(), [*u.begins[1:].tolist(), len(u.doc)]):
        first = u.at[begin]
        w = wanted[d]
        out.append(begin + w[np.searchsorted(w, first) : np.searchsorted(w, first + end - begin)] - first)
    return np.concatenate(out)


def _cut(part: list[tuple]) -> pa.RecordBatch:
    copies = [np.zeros(0, np.int64) if u is None else _units(np.sort(np.array(u, np.int64)), COPY) for _, _, u, *_ in part]
    spans: list[list] = [[] for _ in part]
    some = [k for k, c in enumerate(copies) if len(c)]
    for u in units_of([part[k][1] for k in some]):
        pick = _chosen(u, [copies[k] for k in some])
        for d in np.unique(u.doc[pick]).tolist():
            at = pick[u.doc[pick] == d]
            spans[some[d]].append((u.s0[at], u.s1[at] + LENGTH))
    rows = []
    for (id_, text, _, starts, sizes), found in zip(part, spans):
        if starts:
            x = np.array(starts, np.int64)
            found.append((x, x + np.array(sizes, np.int64) - 1 + LENGTH))
        runs = []
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            first = np.nonzero(np.concatenate([[True], a[1:] > b[:-1]]))[0]
            runs = list(zip(a[first].tolist(), b[np.concatenate([first[1:] - 1, [len(a) - 1]])].tolist()))
        view, sha, at = memoryview(text), hashlib.sha256(), 0
        for a, b in runs:
            sha.update(view[at:a])
            at = b
        sha.update(view[at:])
        rows.append((id_, len(text), sum(b - a for a, b in runs), len(runs), sha.hexdigest(), [{"start": a, "end": b} for a, b in runs]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
