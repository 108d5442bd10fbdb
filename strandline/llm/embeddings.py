"""Near-duplicate embeddings by randomised-rotation binary codes.

Each unit vector o is rotated by one random orthogonal matrix and coded by the signs of its coordinates; the code stands for the
unit vector c with coordinates +-1/sqrt(D). The correction factor a = <c, o> is stored with it. For a vector q of
another block, b = <c, q> gives the unbiased estimate b / a of the cosine <o, q>, with the confidence bound
estimate +- epsilon * sqrt((1 - a^2) / a^2 / (D - 1)): the random rotation leaves the error close to a normal one of that
deviation, so EPSILON = 6 fails for about one linked pair in 10^9. A second bound is certain and needs no estimate: <o, q> is at
most cos(|A - B|) with A = acos a, B = acos b. Pairs whose estimate and bound, from both sides' codes, and whose certain bound
reach the threshold are recomputed exactly in double precision; all others are decided by the codes. In few dimensions (64 and
less) the certain bound decides more pairs, in many the estimate does. `epsilon=None` uses the certain bound alone.

Spark deals each label's vectors into blocks of about BLOCK by a hash; a pair of blocks is one Arrow call. A call returns, for
each vector, how many links it found and one edge of a spanning forest of its links: no pairs leave it, so the output
is linear in a block. Copies (equal vectors of a label) are one vector with a count before that.

Defined results: a null label, a null or empty vector, zero vectors, and vectors with null or non-finite components link with
nothing; vectors of different length don't link; rows that repeat an id count as other vectors, each with its own links and
component, and `kept` says whether the id is the component's smallest; a null id links with nothing; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_skewed, written

BLOCK = 2048
SEED = 20240607
EPSILON = 6.0


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes, and the correction factors <code, vector>."""
    turned = unit @ rotation(unit.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def candidates(codes: np.ndarray, factor: np.ndarray, turned: np.ndarray, least: float, epsilon: float | None = EPSILON) -> np.ndarray:
    """Boolean matrix (coded vectors x rotated unit vectors) of the pairs whose upper bound reaches least."""
    dim = turned.shape[1]
    sign = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    b = (sign @ turned.T.astype(np.float32)) / np.sqrt(dim)
    a = np.clip(factor, 1e-6, 1)[:, None].astype(np.float32)
    near = b + epsilon * np.sqrt((1 - a * a) / max(1, dim - 1)) + 1e-5 >= least * a if epsilon is not None else True
    # cos(|A - B|) >= least  <=>  |A - B| <= T; a little room for single precision.
    angle, turn = np.arccos(a), np.float32(np.arccos(least) + 1e-3)
    low, high = np.cos(np.minimum(angle + turn, np.pi)), np.where(angle > turn, np.cos(np.maximum(angle - turn, 0)), 2.0)
    return (b >= low) & (b <= high) & near


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest position reachable from each of n by the links i-j."""
    root = np.arange(n)
    while True:
        before = root.copy()
        m = np.minimum(root[i], root[j])
        np.minimum.at(root, i, m)
        np.minimum.at(root, j, m)
        root = root[root]
        if (root == before).all():
            return root


def block_links(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, factor: np.ndarray, copies: np.ndarray, side: np.ndarray, same: bool, least: float, epsilon: float | None = EPSILON, step: int = 1024):
    """For the vectors of two blocks (side 0 and 1; same: one block with itself): links of each, and the id of a smaller linked one."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    unit = vectors / norm[:, None]
    turned = unit @ rotation(vectors.shape[1])
    left, right = (np.arange(len(ids)),) * 2 if same else (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0])
    n, ii, jj = np.zeros(len(ids), np.int64), [], []
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        ok = candidates(codes[rows], factor[rows], turned[right], least, epsilon)
        ok &= candidates(codes[right], factor[right], turned[rows], least, epsilon).T
        x, y = np.nonzero(ok)
        x, y = rows[x], right[y]
        if same:
            x, y = x[x < y], y[x < y]
        for m in range(0, len(x), 1 << 16):
            p, q = x[m : m + (1 << 16)], y[m : m + (1 << 16)]
            hit = (vectors[p] * vectors[q]).sum(axis=1) / (norm[p] * norm[q]) >= least
            p, q = p[hit], q[hit]
            np.add.at(n, p, copies[q])
            np.add.at(n, q, copies[p])
            ii.append(p)
            jj.append(q)
    root = _forest(np.concatenate(ii), np.concatenate(jj), len(ids)) if ii else np.arange(len(ids))
    return n, ids[root]


def link_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, epsilon: float | None = EPSILON, block: int = BLOCK) -> DataFrame:
    """One row for each row of df: id_col, n_links, component_id, kept. Ids are integers."""
    own = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    good = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    able = F.col("id").isNotNull() & F.col("label").isNotNull() & good

    classes = own.where(able).groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).cast("long").alias("copies"))
    # Classes have numbers of their own, given once as they are written: rows of one id with other vectors are other classes.
    classes = written(classes.withColumn("dim", F.size("v")).withColumn("rep", F.monotonically_increasing_id()))
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def code(batches):
        for t in batches:
            if t.num_rows:
                dims = np.array(t["dim"].to_pylist())
                codes, factors = [b""] * t.num_rows, np.zeros(t.num_rows)
                values, starts = t["v"].flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
                for d in np.unique(dims):
                    at = np.nonzero(dims == d)[0]
                    v = values[starts[at][:, None] + np.arange(d)]
                    packed, factors[at] = encode(v / np.sqrt((v * v).sum(axis=1))[:, None])
                    for i, c in zip(at, packed):
                        codes[i] = c.tobytes()
                t = t.append_column("code", pa.array(codes, pa.binary())).append_column("factor", pa.array(factors))
                yield t

    coded = dealt.mapInArrow(code, _with(dealt, "code binary, factor double"))
    pairs = coded.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("label", "dim", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), "rep", "v", "code", "factor", "copies")

    def work(t: pa.Table) -> pa.Table:
        d, i, j = t["dim"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
        order = np.argsort(t["rep"].to_numpy())
        t = t.take(pa.array(order))
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        ids = t["rep"].to_numpy()
        n, root = block_links(ids, v, codes, t["factor"].to_numpy(), t["copies"].to_numpy(), t["side"].to_numpy(), i == j, least, epsilon)
        some = np.nonzero((n > 0) | (root != ids))[0]
        return pa.Table.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(root[some])], names=["rep", "n", "root"])

    found = written(pairs.groupBy("label", "dim", "i", "j").applyInArrow(work, "rep long, n long, root long"))
    comps = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "rep")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    info = classes.select("label", "v", "rep", "least", "copies").join(links, "rep", "left").join(comps, "rep", "left")
    info = written(info.select("label", "v", "least", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")).where("n_links > 0"))
    # A component has the smallest id of its classes.
    first = written(info.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")))
    info = written(join_skewed(info, first, ["component"], "classes", info.count()).select("label", "v", "copies", "n_links", "component_id"))
    out = join_skewed(own, info, ["label", "v"], "copies", own.count())
    n, c = F.when(able, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)), F.when(able, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), n.cast("long").alias("n_links"), c.alias("component_id"), F.col("id").eqNullSafe(c).alias("kept"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema] + [more])
