"""Variable-capacity best-fit packing.

Several sequence lengths are permitted and each has a cost. Documents are packed longest first; a piece goes to the
open bin whose room it fills best. If none has room, a bin is opened of the length with the least cost for each token it
is likely to hold: the piece and, of the rest of its room, what the pieces yet to come that fit can fill. When all is
placed each bin is downsized to the smallest permitted length that holds its contents. Documents longer than the
longest bin are cut into full bins and a rest, so nothing is lost.

Sizes are what the size column says: op7 and the pipeline count tokens (op6), since lengths of sequences are in tokens. Without a
size column they are words, which are fewer than tokens and for unspaced text far fewer.

Spark deals the documents by a hash of the id into shards of about SHARD documents; a shard is packed in one Arrow call on
(id, size) pairs. Bins are not shared by shards, which costs at most a few part-filled bins in each of them.

Defined results: null text, texts without words and null sizes have size 0 and a piece of size 0 in the shard's first bin; equal sizes go by id,
null first; an empty table gives an empty result; rows that repeat an id, or have none, are packed as rows of their own; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of, written
from .tokens import token_counts

CAPACITIES = (512, 1024, 2048, 4096)
SHARD = 20_000


def cost(capacity: int) -> float:
    """Of one sequence: linear work, attention that grows with the square, and a fixed part."""
    return 64 + capacity + capacity * capacity / 16384


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """sizes, largest first, none above the largest capacity -> bin and offset of each, and the capacity of each bin."""
    capacities = sorted(capacities)
    top = capacities[-1]
    volume = np.zeros(top + 1)
    np.add.at(volume, np.asarray(sizes, np.int64), np.asarray(sizes, float))
    volume = volume.tolist()  # what is yet to come, by the size of their piece
    open_bins: list[list[int]] = [[] for _ in range(top + 1)]  # by room
    rooms = 0  # bit r is set if a bin has room r
    bins, offsets, used, caps = [], [], [], []
    for size in sizes:
        volume[size] -= size
        rest = rooms >> size
        if rest:
            room = size + (rest & -rest).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            best = None
            for c in capacities:
                if c >= size:
                    need, fill = c - size, 0.0
                    for s in range(min(need, size), 0, -1):
                        fill += volume[s]
                        if fill >= need:
                            break
                    each = cost(c) / max(1, size + min(need, fill))
                    if best is None or each < best[0]:
                        best = (each, c)
            b, room = len(caps), best[1]
            caps.append(best[1])
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        open_bins[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES, shard: int = SHARD, size_col: str | None = None) -> DataFrame:
    """One row for each piece: id_col, piece, size, doc_start (what of the document is before it), bin_id, capacity, bin_start.

    With size_col the text isn't read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    top = max(capacities)
    size = F.coalesce(F.col(size_col), F.lit(0)) if size_col else F.regexp_count(text_of(text_col), F.lit(WORD))
    sized = written(df.select(F.col(id_col).alias("id"), size.cast("long").alias("size")))
    n = max(1, -(-sized.count() // shard))
    # A repeated id would put all its rows in one shard, so the size takes part in the deal as well; rows without an id are dealt by their place in the written table.
    place = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("id", "size", place), F.lit(n)))
    kind = to_arrow_type(sized.schema["id"].dataType)

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, s = table["id"].to_pylist(), table["size"].to_pylist(), table["shard"][0].as_py()
        parts = [(min(top, z - k), i, p, k) for i, z in zip(ids, sizes) for p, k in enumerate(range(0, max(1, z), top))]
        parts.sort(key=lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0, x[2]))
        b, at, caps = pack([x[0] for x in parts], capacities)
        cols = [[x[1] for x in parts], [x[2] for x in parts], [x[0] for x in parts], [x[3] for x in parts], [f"{s}-{k}" for k in b], [caps[k] for k in b], at]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["id", "piece", "size", "doc_start", "bin_id", "capacity", "bin_start"])

    schema = f"id {sized.schema['id'].dataType.simpleString()}, piece long, size long, doc_start long, bin_id string, capacity long, bin_start long"
    return dealt.groupBy("shard").applyInArrow(run, schema).withColumnRenamed("id", id_col)


def pack_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """pack_documents with sizes in tokens of the tokenizer file at path; they are counted once."""
    counted = token_counts(df, path, id_col, text_col).select(id_col, "n_tokens")
    return pack_documents(counted, id_col, capacities=capacities, shard=shard, size_col="n_tokens")
