"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1-, 2- and 3-grams of lower-cased letters for each language on a bounded sample of the labelled
rows (at most about TRAIN_ROWS for each language, by a hash of the id); counts are summed by Spark and the matrix of log
probabilities (languages x BUCKETS) is broadcast. Scoring turns a batch of whole texts into one array of code points,
hashes all n-grams at once, gathers the matrix's columns and sums them by text: the sparse product of counts and matrix.

Every label is learned; more than MOST_LANGUAGES of them raise an error, as the matrix has 256 KB for each. Long texts are scored in
pieces of PIECE characters that lose no n-gram at their ends.

score is the posterior of the predicted language under a uniform prior, tempered by the root of the number of n-grams
(their counts are far from independent). Defined results: null text, or one without a letter, is `und` with score 0; with
nothing to learn from all is `und`; ties go to the smallest language; a null id is held out; rows that repeat an id are
predicted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .tokens import byte_batches, rows_of

BUCKETS = 1 << 16
TRAIN_ROWS = 4000
MOST_LANGUAGES = 1024
PIECE = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.1


def _letters(code: np.ndarray) -> np.ndarray:
    kinds, back = np.unique(code, return_inverse=True)
    return np.fromiter((chr(c).isalpha() for c in kinds.tolist()), bool, len(kinds))[back]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _hashed(code: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(code) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and the text of each. A run of other characters than letters is one space."""
    low = [x.lower() for x in texts]
    code = _codes("\n".join(low) + "\n")
    ends = np.cumsum([len(x) + 1 for x in low]) if low else np.zeros(0, np.int64)
    letter = _letters(code)
    text = np.searchsorted(ends, np.arange(len(code)), side="right")
    keep = letter | np.concatenate([[True], letter[:-1]]) | (text != np.concatenate([[-1], text[:-1]]))
    code, text, letter = np.where(letter, code, 32)[keep].astype(np.uint64), text[keep], letter[keep]
    hashes, owners = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        h = _hashed(code, n)
        ok = text[: len(h)] == text[n - 1 :]
        ok &= letter[: len(h)] if n == 1 else True
        hashes.append((h[ok] & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(text[: len(h)][ok])
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def long_grams(text: str, most: int = PIECE) -> Iterator[np.ndarray]:
    """The same hashed n-grams of one text, in pieces: each carries on from the last letters of the one before, so every n-gram comes once."""
    low, carry, before = text.lower() + "\n", np.zeros(0, np.uint64), True
    for k in range(0, len(low), most):
        code = _codes(low[k : k + most])
        letter = _letters(code)
        keep = letter | np.concatenate([[before], letter[:-1]])
        before = bool(letter[-1])
        fresh = np.where(letter, code, 32)[keep].astype(np.uint64)
        code, out = np.concatenate([carry, fresh]), []
        for n in ORDERS:
            at = max(0, len(carry) - n + 1)
            if len(code) - at >= n:
                h = _hashed(code[at:], n)
                out.append((h[code[at:] != 32] if n == 1 else h) & np.uint64(BUCKETS - 1))
        carry = code[-(max(ORDERS) - 1) :]
        yield np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def gram_batches(texts: list[str], most: int = PIECE, together: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams and the text of each: short texts many at a time, longer ones in pieces."""
    short = [i for i, x in enumerate(texts) if len(x) <= most]
    for k in range(0, len(short), together):
        part = short[k : k + together]
        h, owner = grams([texts[i] for i in part])
        yield h, np.array(part, np.int64)[owner]
    for i, x in enumerate(texts):
        if len(x) > most:
            for h in long_grams(x, most):
                yield h, np.full(len(h), i, np.int64)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the matrix of log probabilities. Only the columns named are read; all rows of df are for training."""
    text_batches(df.sparkSession)
    labelled = df.where(F.col(lang_col).isNotNull())
    n = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().limit(most_languages + 1).collect()}
    if len(n) > most_languages:
        raise ValueError(f"more than {most_languages} labels: the matrix has {4 * BUCKETS >> 10} KB for each; raise most_languages if workers have the memory")
    langs = sorted(n)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows / n[k]))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1_000_000)) / 1e6
    place = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]):
        for part in byte_batches(rows_of(batches), 1):
            own = np.array([place[r[0]] for r in part])
            found = [own[owner] * BUCKETS + h for h, owner in gram_batches([r[1] for r in part])]
            at, total = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total)], ["cell", "n"])

    drawn = labelled.where((draw < F.element_at(share, F.col(lang_col))) & F.col(text_col).isNotNull()).select(lang_col, text_col)
    got = drawn.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most languages x BUCKETS rows
    counts = np.full(len(langs) * BUCKETS, SMOOTHING, np.float32)
    counts[got["cell"].to_numpy()] += got["n"].to_numpy()
    counts = counts.reshape(len(langs), BUCKETS)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32)


def score(texts: list[str], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    n, like = np.zeros(len(texts)), np.zeros((len(texts), len(langs)))
    for h, owner in gram_batches(texts):
        n += np.bincount(owner, minlength=len(texts))
        for i, weights in enumerate(matrix):
            like[:, i] += np.bincount(owner, weights=weights[h], minlength=len(texts))
    some = n > 0
    if not langs or not some.any():
        return ["und"] * len(texts), [0.0] * len(texts)
    best = like.argmax(axis=1)
    gap = (like - like.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
    post = 1.0 / np.exp(gap).sum(axis=1)
    return [langs[b] if s else "und" for b, s in zip(best, some)], np.where(some, post, 0.0).tolist()


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, lang_pred, score. Only the text is looked at."""
    from pyspark.sql.pandas.types import to_arrow_type

    text_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES * BUCKETS * 4 bytes, else train has raised

    def run(batches: Iterator[pa.RecordBatch]):
        langs, matrix = shared.value
        for part in byte_batches(rows_of(batches), 1, 1 << 18):
            lang, p = score([r[1] for r in part], langs, matrix)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], kind), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["id", "lang_pred", "score"])

    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = to_arrow_type(source.schema["id"].dataType)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts all: id_col, held_out, lang_pred, score. A null id is held out."""
    apart = F.coalesce(held_out(id_col), F.lit(True))
    model = train(df.where(~apart), text_col, lang_col, id_col)
    return predict(df, model, id_col, text_col).select(id_col, apart.alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df without the rows whose language can't be told: `und`, or a score under `least`. With nothing to learn from, only rows without a letter go.

    All columns stay, whatever their names; rows that repeat an id go together, and rows with a null id stay.
    """
    apart = F.coalesce(held_out(id_col), F.lit(True))
    model = train(df.where(~apart), text_col, lang_col, id_col)
    if not model[0]:
        return df.where(F.coalesce(F.regexp_like(F.col(text_col), F.lit(r"\p{L}")), F.lit(False)))
    gone = predict(df, model, id_col, text_col).where((F.col("lang_pred") == "und") | (F.col("score") < least)).select(id_col)
    return df.join(gone, id_col, "left_anti")
