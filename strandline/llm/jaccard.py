"""Exact n-gram Jaccard join: size-aware, heavy and light.

Two sets of sizes s <= t with a Jaccard similarity of at least J share o = ceil(J / (1 + J) * (s + t)) elements and t <= s / J.

1. Copies. Documents with equal sets are one class (tree merge of set digests); only its smallest id goes on.
2. Light: sets of at most x elements enumerate, for each size t they can link with, their subsets of o elements. A set of size
   s and one of size t share a key (s, t, subset) if and only if they link; two of size t may share it without. So a key
   is a star around the smallest id of its sets of size s, and nothing if it has none.
3. Heavy: larger sets, and smaller ones within their reach, are put into inverted lists of their prefixes: the
   t - ceil(J * t) + 1 elements that come first in an order in which common elements are last. Two sets that link share
   one. Which elements are common is counted over all documents; a table of bounded size holds the commonest.
4. The boundary x has the least cost, counted from all sizes: subsets below it, list entries above it.

Lists of at most LONG members are paired. Longer ones, and those of common elements, are first compared with pivots, the members with
the fewest uncommon elements, in ROUNDS of verification; members that reach one component need not be compared with each other, as only
components are asked for. The pairs that are then left in different components are all compared, in pairs of blocks of the
list, so no component loses a link and no list is one task. New links join components, not documents.

Verification takes whole sets of the documents in question and counts what they share.
Defined results: null and empty texts have the empty set and link with nothing; rows that repeat an id have one set by the first of
their digests and the smallest component; a null id links with nothing; an empty table gives an empty result; other
columns are not read by the join and stay as they are in drop_near.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import connected_components, fit_broadcast, join_skewed, maybe_in, text_batches, text_of, written
from .exact_dedup import tree_merge
from .shingles import shingle_sets
from .tokens import byte_batches, rows_of

WORDS, PERCENT = 5, 80
#: Documents an element must be in to be common, and elements the table of common ones holds.
COMMON, MOST_COMMON = 8, 1_000_000
#: Rounds of comparing long lists with pivots before what is left is paired; members of a list that is paired at once, and of a block of one that is not.
ROUNDS, LONG, BLOCK = 2, 64, 512
LARGEST_LIGHT = 24


def overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """Least number of shared elements of linked sets: 100 i >= percent (s + t - i)."""
    return -(-percent * (s + t) // (100 + percent))


def reach(s: int, percent: int = PERCENT) -> range:
    """Sizes t >= s that can link with s: the overlap is at most s."""
    return range(s, 100 * s // percent + 1)


def prefix_length(t: int, percent: int = PERCENT) -> int:
    """A linked set shares at least ceil(J t) elements of a set of t elements."""
    return t - -(-percent * t // 100) + 1


def subset_count(n: int, percent: int = PERCENT) -> int:
    """Keys a light set of n elements makes: with sizes from its own up, and as the larger of two."""
    up = sum(math.comb(n, overlap(n, t, percent)) for t in reach(n, percent))
    return up + sum(math.comb(n, overlap(s, n, percent)) for s in range(1, n) if n in reach(s, percent))


def boundary(sizes: dict[int, int], percent: int = PERCENT, entry_cost: float = 4.0) -> int:
    """The x in 0..LARGEST_LIGHT of least cost. An entry of an inverted list costs entry_cost subset keys: it is joined, and its pairs verified."""
    def cost(x: int) -> float:
        light = sum(c * subset_count(n, percent) for n, c in sizes.items() if 0 < n <= x)
        return light + entry_cost * sum(c * prefix_length(n, percent) for n, c in sizes.items() if n > 0 and 100 * n >= percent * (x + 1))

    return min(range(LARGEST_LIGHT + 1), key=cost)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def subset_keys(values: np.ndarray, most: int, percent: int = PERCENT) -> list[bytes]:
    """Digests of (s, t, subset) for every size at most `most` that the set can link with; the last byte tells whether the set has size s."""
    n, got = len(values), values.tolist()
    pairs = [(n, t) for t in reach(n, percent) if t <= most] + [(s, n) for s in range(1, n) if n in reach(s, percent)]
    return [hashlib.blake2b(repr((s, t, c)).encode(), digest_size=16).digest() + bytes([n == s]) for s, t in pairs for c in combinations(got, overlap(s, t, percent))]


def _sets(batches, words: int):
    for part in byte_batches(rows_of(batches), 1, 1 << 18):
        yield part, shingle_sets([r[1] for r in part], words)


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text"))


def _packed(x: np.ndarray) -> bytes:
    """Sorted uint32: the first and the steps, in two bytes each where they fit."""
    step = np.diff(x)
    return x[:1].tobytes() + (b"\2" + step.astype(np.uint16).tobytes() if not len(step) or step.max() < 1 << 16 else b"\4" + step.tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    step = np.frombuffer(x, np.uint16 if x[4] == 2 else np.uint32, offset=5)
    return np.cumsum(np.concatenate([np.frombuffer(x, np.uint32, 1), step]), dtype=np.uint64).astype(np.uint32)


def common_elements(source: DataFrame, words: int, least: int = COMMON, most: int = MOST_COMMON) -> tuple[np.ndarray, dict[int, int]]:
    """The elements in at least `least` documents, by their upper 32 bits, sorted: at most `most` of the commonest; and the histogram of small sizes.

    Batches send, for each of a number of buckets of the hash, their elements as one packed row with counts, so what is
    shuffled is about two bytes an element and no bucket grows with a common one. The order is only to be the same for all
    documents, so elements that agree in 32 bits may share a count.
    """
    spark = source.sparkSession
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(5, min(16, (total // (16 << 20)).bit_length()))
    shift = np.uint32(32 - buckets.bit_length() + 1)

    def send(batches):
        pending, held, sizes = [], 0, np.zeros(LARGEST_LIGHT * 2, np.int64)

        def packed():
            e, n = np.unique(np.concatenate(pending), return_counts=True)
            at = np.searchsorted((e >> shift).astype(np.int64), np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                x, c = e[at[b] : at[b + 1]], n[at[b] : at[b + 1]]
                if len(x):
                    more = c > 1
                    rows.append((b, _packed(x), np.nonzero(more)[0].astype(np.uint32).tobytes(), c[more].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "e", "at", "n"])

        for part, sets in _sets(batches, words):
            for s in sets:
                if 0 < len(s) < len(sizes):
                    sizes[len(s)] += 1
            pending += [(s >> np.uint64(32)).astype(np.uint32) for s in sets if len(s)]
            held += sum(map(len, sets))
            if held > 1 << 20:
                yield packed()
                pending, held = [], 0
        if pending:
            yield packed()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([sizes.tobytes()]), pa.array([b""]), pa.array([b""])], ["bucket", "e", "at", "n"])

    def count(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() < 0:
            sizes = sum(np.frombuffer(x, np.int64) for x in t["e"].to_pylist())
            return pa.table({"kind": pa.array([0] * len(sizes), pa.int32()), "e": pa.array(range(len(sizes)), pa.int64()), "n": pa.array(sizes, pa.int64())})
        e, n = [], []
        for x, at, c in zip(*(t[k].to_pylist() for k in ("e", "at", "n"))):
            e.append(_unpacked(x))
            one = np.ones(len(e[-1]), np.int64)
            one[np.frombuffer(at, np.uint32)] = np.frombuffer(c, np.uint32)
            n.append(one)
        e, n = np.concatenate(e), np.concatenate(n)
        order = np.argsort(e, kind="stable")
        e, n = e[order], n[order]
        first = np.nonzero(np.concatenate([[True], e[1:] != e[:-1]]))[0]
        total = np.add.reduceat(n, first)
        hot = total >= least
        return pa.table({"kind": pa.array([1] * int(hot.sum()), pa.int32()), "e": pa.array(e[first][hot], pa.int64()), "n": pa.array(total[hot], pa.int64())})

    counted = written(source.mapInArrow(send, "bucket int, e binary, at binary, n binary").groupBy("bucket").applyInArrow(count, "kind int, e long, n long"))
    sizes = {r["e"]: r["n"] for r in counted.where("kind = 0 and n > 0").collect()}
    hot = counted.where("kind = 1").orderBy(F.desc("n"), "e").select("e").limit(most).toArrow()["e"].to_numpy()
    return np.sort(hot.astype(np.uint32)), sizes


def class_sets(source: DataFrame, words: int, hot: np.ndarray, x: int, percent: int) -> DataFrame:
    """id, n, digest, rare (number of uncommon elements), keys (light subset keys), prefix and common (uncommon and common elements of the heavy prefix)."""
    shared = source.sparkSession.sparkContext.broadcast(hot)  # at most MOST_COMMON numbers of four bytes
    kind = to_arrow_type(source.schema["id"].dataType)

    def run(batches):
        common = shared.value
        for part, sets in _sets(batches, words):
            rows = []
            for s in sets:
                if not len(s):
                    rows.append((0, b"", 0, [], [], []))
                    continue
                top = (s >> np.uint64(32)).astype(np.uint32)
                at = np.searchsorted(common, top)
                is_hot = common[np.minimum(at, len(common) - 1)] == top if len(common) else np.zeros(len(s), bool)
                k = prefix_length(len(s), percent) if 100 * len(s) >= percent * (x + 1) else 0
                cold, warm = s[~is_hot], s[is_hot]
                rows.append((len(s), _digest(s), len(cold), subset_keys(s, x, percent) if len(s) <= x else [], cold[:k].view(np.int64), warm[: max(0, k - len(cold))].view(np.int64)))
            cols = [[r[0] for r in part], *zip(*rows)]
            kinds = (kind, pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "n", "digest", "rare", "keys", "prefix", "common"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n int, digest binary, rare int, keys array<binary>, prefix array<long>, common array<long>")


def whole_sets(source: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, e (the whole set) of the documents with these ids, and of a few others. Texts are filtered where they are read, not shuffled."""
    kind = to_arrow_type(source.schema["id"].dataType)

    def run(batches):
        for part, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], kind), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "e"])

    texts = maybe_in(source, ids).where("maybe").select("id", "text")
    return written(texts.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, e array<long>"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """The rows of written pairs (u, v, and more) whose sets link.

    An id in many pairs, as a pivot's v is, has its partners dealt into blocks of about `block`, and its set goes once to each of them.
    """
    rows = pairs
    for side, other, e in (("u", "v", "a"), ("v", "u", "b")):
        own = sets.select(F.col("id").alias(side), F.col("e").alias(e))
        many = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > block).select(side, F.ceil(F.col("_m") / block).cast("int").alias("_parts"))
        if not many.take(1):
            rows = rows.join(own, side)
            continue
        many = fit_broadcast(many)
        own = own.join(many, side, "left").select(side, e, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
        rows = rows.join(many, side, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")).cast("int"), F.lit(0)))
        rows = rows.join(own, [side, "_part"]).drop("_part", "_parts")
    shared = F.size(F.array_intersect("a", "b"))
    return rows.where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select(*pairs.columns)


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    light: int | None = None, least_common: int = COMMON, most_common: int = MOST_COMMON, rounds: int = ROUNDS, long: int = LONG, block: int = BLOCK,
) -> DataFrame:
    """One row for each row of df: id_col, n_shingles, component_id. `light` sets the boundary in place of its cost; like what follows it, it changes no result."""
    text_batches(df.sparkSession)
    source = _source(df, id_col, text_col)
    hot, sizes = common_elements(source, words, least_common, most_common)
    x = boundary(sizes, percent) if light is None else light
    own = written(class_sets(source, words, hot, x, percent).withColumn("run", F.spark_partition_id()))

    # 1. Copies: the smallest id of each digest stands for its class.
    some = own.where("n > 0 and id is not null")
    groups = written(tree_merge(some.select("digest", "id", "run"), ["digest"], "id").where("group_size > 1").withColumnRenamed("id", "rep"))
    placed = written(join_skewed(own.select("id", "n", "digest"), groups, ["digest"], "group_size", own.count()).select("id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep")))
    copies = placed.where("id <> rep").select("id")
    sifted = maybe_in(some, copies)
    reps = sifted.where("not maybe").unionByName(sifted.where("maybe").join(copies, "id", "left_anti"))

    # 2. Light: a key is a star around the smallest id of its sets of the smaller size.
    keys = reps.where(F.size("keys") > 0).select("id", F.explode("keys").alias("key"))
    keys = written(keys.select("id", F.expr("substring(key, 1, 16)").alias("key"), (F.expr("substring(key, 17, 1)") == F.lit(b"\1")).alias("small")))
    stars = keys.groupBy("key").agg(F.min(F.when(F.col("small"), F.col("id"))).alias("v"), F.count(F.lit(1)).alias("m")).where("m > 1 and v is not null")
    light_links = join_skewed(keys, written(stars), ["key"], "m", keys.count()).where("id <> v").select(F.col("id").alias("u"), "v")

    # 3. Heavy: pairs of the short lists; the long ones are kept.
    lists = reps.where(F.size("prefix") > 0).select("id", "n", "rare", F.posexplode("prefix").alias("pos", "e"))
    lists = lists.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("e"))).where("m > 1")
    pairs = written(_paired(lists.where(F.col("m") <= long).select("id", "n", "pos", "e"), percent).distinct())
    common = reps.where(F.size("common") > 0).select("id", "n", "rare", F.posexplode("common").alias("pos", "e")).withColumn("pos", F.col("pos") + F.col("rare"))
    met = written(common.groupBy("e").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    total = met.agg(F.sum("m")).first()[0] or 0
    common = join_skewed(common, met, ["e"], "m", total).where("m is not null")
    longer = lists.where(F.col("m") > long)
    members = written(common.unionByName(longer) if total else longer)
    total = members.count()

    sets = whole_sets(source, pairs.select(F.explode(F.array("u", "v")).alias("id")).unionByName(members.select("id")), words)
    comps = connected_components(light_links.unionByName(verified(pairs, sets, percent)))
    for round_ in range(rounds if total else 0):
        member = _placed(members, comps)
        # A list's pivot is its member with the fewest uncommon elements; in later rounds, that of those which no pivot has reached.
        best = F.min(F.struct("rare", "id", "n", "c")).alias("p")
        pivot = member.groupBy("e", "m").agg(best)
        if round_:
            rest = join_skewed(member.drop("m"), pivot, ["e"], "m", total).where(F.col("c") != F.col("p.c")).drop("p")
            pivot = rest.groupBy("e", "m").agg(best)
        near = join_skewed(member.drop("m"), pivot, ["e"], "m", total)
        near = near.where((F.col("c") != F.col("p.c")) & (100 * F.least("n", F.col("p.n")) >= percent * F.greatest("n", F.col("p.n"))))
        pairs = written(near.select(F.col("id").alias("u"), F.col("p.id").alias("v"), F.col("c").alias("cu"), F.col("p.c").alias("cv")).distinct())
        if not pairs.take(1):
            break
        comps = joined(comps, verified(pairs, sets, percent))
    if total:
        member = _placed(members, comps)
        torn = member.groupBy("e", "m").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("e", "m")
        member = join_skewed(member.drop("m"), torn, ["e"], "m", total).where("m is not null")
        pairs = written(_paired(_blocks(member.select("id", "n", "pos", "e", "c", "m"), block), percent).distinct())
        if pairs.take(1):
            comps = joined(comps, verified(pairs, sets, percent))

    # A component's smallest id may stand for a class, whose smallest id it is, so it is the smallest of all its members.
    sized = placed.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    moved = written(comps.withColumnRenamed("id", "rep").join(sized, "rep"))
    out = join_skewed(placed, moved, ["rep"], "size", placed.count())
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _placed(lists: DataFrame, comps: DataFrame) -> DataFrame:
    return written(lists.join(comps, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"))


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps(id, component) after the links between components cu and cv."""
    more = connected_components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    to = fit_broadcast(more.select(F.col("id").alias("component"), F.col("component").alias("to")))
    moved = comps.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return written(moved.unionByName(more.join(comps.select("id"), "id", "left_anti").select("id", "component")))


def _blocks(lists: DataFrame, block: int) -> DataFrame:
    """Each row of a list of m members once for each pair (i, j) of blocks it takes part in."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    b = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = lists.withColumn("blocks", blocks).withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("m", "blocks", "b", "o")


def _paired(lists: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the members of each list that can link: by their sizes, by what follows the element in both, and, where told, by being in different components (cu, cv)."""
    a = lists.select(*[F.col(c).alias(f"a_{c}") for c in lists.columns])
    b = lists.select(*[F.col(c).alias(f"b_{c}") for c in lists.columns])
    n, m = F.col("a_n"), F.col("b_n")
    left = 1 + F.least(n - F.col("a_pos") - 1, m - F.col("b_pos") - 1)
    ok = (F.col("a_id") > F.col("b_id")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * left >= percent * (n + m))
    for key in [k for k in ("e", "i", "j") if k in lists.columns]:
        ok &= F.col(f"a_{key}") == F.col(f"b_{key}")
    out = [F.col("a_id").alias("u"), F.col("b_id").alias("v")]
    if "c" in lists.columns:
        ok &= F.col("a_c") != F.col("b_c")
        out += [F.col("a_c").alias("cu"), F.col("b_c").alias("cv")]
    return a.join(b, ok).select(*out)


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """df with one row of each component, the smallest id; all columns stay, whatever their names. Ids are taken to be unique; rows with a null id stay."""
    gone = jaccard_components(df, id_col, text_col, words, percent).where(F.col(id_col) != F.col("component_id")).select(id_col)
    return df.join(gone, id_col, "left_anti")
