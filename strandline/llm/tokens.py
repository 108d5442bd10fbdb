"""Token counts in Arrow functions that return lengths only.

Texts are gathered into batches of about BATCH_BYTES bytes, whatever their number, and longer ones are split at safe boundaries into
parts of about that size. For byte-level BPE files the boundaries are those that no pre-token crosses whatever surrounds
them: before ASCII white space that follows something else, and between ASCII letters, digits and other signs (but not
after an apostrophe or next to other characters than ASCII). All of them cut a batch into pieces at once, in numpy; the pieces' tokens
are the text's.

Pieces repeat as words do: each worker remembers the ids of the pieces of at most SHORT bytes it has met (REMEMBERED at
most), by 64-bit hash, and has the library encode, as lines of joint texts, only those it has not. Longer pieces go to the library each
time. Texts that hold the string of a special token go to it whole, as do all texts for other tokenizer files.

Defined results: null is empty; an empty text has 0 tokens; strings of special tokens inside a text are what the
library makes of them by default; rows that repeat an id are counted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, text_of
from .shingles import hashes_of

BATCH_BYTES = 1 << 20
REMEMBERED, SHORT = 1_000_000, 64
SLOTS = 1 << 22
# Latin letters (to U+024F, in UTF-8) with at most one space before them: one pre-token.
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
# How byte-level files show bytes: printable ones as themselves, the others from U+0100 on.
_shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_shown |= {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _shown)}
# White space of the Unicode property that isn't ASCII, in UTF-8.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_loaded: dict[str, Encoder] = {}

# Classes of bytes: 0 not ASCII, 1 white space, 2 letter, 3 digit, 4 apostrophe, 5 any other.
_class = np.zeros(256, np.uint8)
_class[:128] = 5
_class[[32, *range(9, 14)]], _class[[*range(65, 91), *range(97, 123)]], _class[48:58], _class[39] = 1, 2, 3, 4
_safe = np.zeros((6, 6), bool)
_safe[[0, 2, 3, 4, 5], 1] = True
_safe[2, [3, 4, 5]] = _safe[3, [2, 4, 5]] = _safe[5, [2, 3]] = True
_safe[4, 3] = True


def cuts(raw: bytes) -> np.ndarray:
    """Whether a piece starts at each byte; the first byte doesn't count."""
    data = np.frombuffer(raw, np.uint8)
    kind = _class[data]
    out = np.zeros(len(data), bool)
    out[1:] = _safe.reshape(-1)[kind[:-1] * np.uint8(6) + kind[1:]]
    for m in WIDE_SPACE.finditer(raw):
        out[m.end() : m.end() + 1] = False
    return out


def parts(raw: bytes, most: int = BATCH_BYTES) -> Iterator[bytes]:
    """raw in parts of about `most` bytes, split at safe boundaries."""
    begin, size = 0, most
    while len(raw) - begin > size:
        at = np.nonzero(cuts(raw[begin : begin + size]))[0]
        if len(at):
            yield raw[begin : begin + int(at[-1])]
            begin, size = begin + int(at[-1]), most
        else:
            size *= 2
    yield raw[begin:]


class Memory:
    """Ids of pieces by 64-bit hash: an open-addressing table in numpy, so that a batch is looked up at once."""

    def __init__(self, slots: int = SLOTS) -> None:
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.key, self.row = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.start, self.count, self.rows = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.pool, self.size = np.zeros(1 << 14, np.uint32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for those not met."""
        out, left, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            key = self.key[slot]
            same = key == h[left]
            out[left[same]] = self.row[slot[same]]
            go = ~same & (key != 0)
            left, slot = left[go], (slot[go] + 1) & (self.slots - 1)
        return out

    def put(self, ids: list) -> np.ndarray:
        """Rows for lists of ids."""
        n, size = len(ids), list(map(len, ids))
        more = np.fromiter(chain.from_iterable(ids), np.uint32, sum(size))
        while self.rows + n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.size + len(more) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        at = np.arange(self.rows, self.rows + n)
        self.count[at], self.start[at] = size, self.size + np.cumsum([0, *size])[:-1]
        self.pool[self.size : self.size + len(more)] = more
        self.rows, self.size = self.rows + n, self.size + len(more)
        return at

    def learn(self, h: np.ndarray, row: np.ndarray) -> None:
        """Distinct hashes that are not in the table."""
        left, slot = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[left[free]]
            won = free & (self.key[slot] == h[left])
            self.row[slot[won]] = row[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (self.slots - 1)


class Encoder:
    """Encodes texts, given as UTF-8, with the tokenizer file at path."""

    def __init__(self, path: str) -> None:
        self.memory, self.special, self.splits = Memory(), [], False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.special, self.splits = _told(model)
            self.model = model.model

    def of(self, texts: list[bytes], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (none if not wanted), and how many each text has."""
        count, out = np.zeros(len(texts), np.int64), []
        held: list[tuple[int, bytes]] = []
        size = 0

        def pieced():
            nonlocal held, size
            if held:
                n, got = self._pieces([x for _, x in held], ids)
                np.add.at(count, [k for k, _ in held], n)
                out.append(got)
                held, size = [], 0

        for k, x in enumerate(texts):
            if not self.splits or any(s in x for s in self.special):
                pieced()
                got = np.asarray(self.encode([x.decode("utf-8", "replace")])[0], np.uint32)
                count[k] = len(got)
                out.append(got)
                continue
            for part in parts(x) if len(x) > BATCH_BYTES else (x,):
                held.append((k, part))
                size += len(part)
                if size >= BATCH_BYTES:
                    pieced()
        pieced()
        return np.concatenate(out) if ids and out else np.zeros(0, np.uint32), count

    def _pieces(self, texts: list[bytes], ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids."""
        memory, raw = self.memory, b"".join(texts)
        begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        cut = cuts(raw)
        cut[begin[:-1][begin[:-1] < len(raw)]] = True
        start = np.nonzero(cut)[0]
        end = np.append(start[1:], len(raw))[: len(start)]
        h = hashes_of(np.frombuffer(raw, np.uint8), start, end)
        h[h == 0] = 1
        if memory.rows > REMEMBERED or memory.size > 8 * REMEMBERED:
            memory.clear()
        row, short = np.full(len(start), -1, np.int64), np.nonzero(end - start <= SHORT)[0]
        row[short] = memory.find(h[short])
        fresh = short[row[short] < 0]
        if len(fresh):
            new, first = np.unique(h[fresh], return_index=True)
            at = fresh[first]
            memory.learn(new, memory.put(self._new([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])))
            row[fresh] = memory.find(h[fresh])
        long = np.nonzero(row < 0)[0]
        rows, size = memory.rows, memory.size
        if len(long):
            row[long] = memory.put(self.encode([raw[start[k] : end[k]].decode("utf-8", "replace") for k in long.tolist()]))
            memory.rows, memory.size = rows, size  # for this batch only
        count = memory.count[row]
        total = np.concatenate([[0], np.cumsum(count)])
        edge = total[np.searchsorted(start, begin)]
        if not ids:
            return np.diff(edge), np.zeros(0, np.uint32)
        return np.diff(edge), memory.pool[np.repeat(memory.start[row] - total[:-1], count) + np.arange(total[-1])]

    def _new(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces that have not been met: one Latin word is one pre-token and goes straight to the library's model."""
        word = [WORD.fullmatch(x) is not None for x in pieces]
        shown, at, model = b"".join([x for x, w in zip(pieces, word) if w]).decode("latin-1").translate(_shown), 0, self.model
        rest = iter(self.encode([x.decode("utf-8", "replace") for x, w in zip(pieces, word) if not w]))
        out = []
        for x, w in zip(pieces, word):
            if w:
                out.append([t.id for t in model.tokenize(shown[at : at + len(x)])])
                at += len(x)
            else:
                out.append(next(rest))
        return out


def _told(model) -> tuple[list[bytes], bool]:
    """The strings of added tokens, and whether the file is a byte-level BPE with the usual pattern, no prefix space and no normaliser."""
    import json

    told = json.loads(model.to_str())
    pre = told.get("pre_tokenizer") or {}
    added = [x["content"].encode() for x in told.get("added_tokens") or []]
    return added, not told.get("normalizer") and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _bytes(x: str | bytes) -> int:
    return len(x) if isinstance(x, bytes) or x.isascii() else len(x.encode("utf-8", "replace"))


def byte_batches(rows: Iterable[tuple], text: int, most: int = BATCH_BYTES) -> Iterator[list[tuple]]:
    """rows in lists whose texts (item `text` of each) have about `most` bytes together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += _bytes(row[text])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row for each row of df: id_col, n_bytes, n_tokens, over_limit."""
    from pyspark.sql.pandas.types import to_arrow_type

    def count(batches):
        enc = encoder(path)
        for rows in byte_batches(rows_of(batches), 1):
            texts = [r[1] for r in rows]
            _, n = enc.of(texts, ids=False)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array(list(map(len, texts)), pa.int64()), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    text_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    kind = to_arrow_type(source.schema["id"].dataType)
    out = source.mapInArrow(count, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
