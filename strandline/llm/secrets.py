"""Secret scans: fixed patterns, and a randomness test battery on what else looks like a key.

Candidates are maximal runs of TOKEN characters outside the fixed patterns' spans, cut at every `=` that is not padding at
the run's end; a run that mixes `+/` with `-_` is no one encoding and gives its runs without `-_`, without `+/` and without
both, so spans of such a run may overlap. Each, CANDIDATE or longer, is tested in the smallest alphabet that holds its
characters (decimal, hex, base32, base36, base62, base64; hex and base36 in lower or upper case). The battery:

* fit to randomness: chi-squared of the symbol counts against a uniform alphabet, the Wald-Wolfowitz runs of symbols above
  and below the alphabet's middle, and the lag-one serial correlation of symbol values. A candidate that one of them
  rejects at FIT / 3 is not a key.
* evidence against ordinary text: the p-value of a chi-squared as small as seen if symbols repeated as often as in
  words (a non-central chi-squared), and of as many changes of character class (binomial), joined by Fisher's method.

The evidence is a p-value whose power grows with the length, so short candidates rarely reach it. Benjamini-Hochberg
at rate FDR runs over all candidates of the corpus, separately in each band of lengths: their p-values are counted in
fixed bins by Spark, the threshold of a band comes from its bins, and the spans under it are added.

Defined results: null text is empty and has no spans; with no candidates nothing is added; candidates of equal p-value are added or left
together; a run of any length is tested whole; rows that repeat an id, or have none, are scanned each; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, text_of, written
from .tokens import byte_batches, rows_of

KINDS = ("assign", "access", "hex")
# The patterns of the three kinds and the least lengths of what they must hold.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

CANDIDATE = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE)
FIT, FDR = 0.01, 0.01
# A run between signs of equality with its padding, and the runs of one kind in it.
VALUE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
UNMIXED = [re.compile(x) for x in (r"[A-Za-z0-9+/]+=*", r"[A-Za-z0-9_-]+=*", r"[A-Za-z0-9]+=*")]
BANDS = (20, 28, 40, 64)
BINS, BIN_WIDTH = 400, 0.1
# Ordinary text: how often two symbols of a word agree, and how often neighbours differ in class (lower, upper, digit, other).
WORD_MATCH, CLASS_CHANGE = 0.065, 0.12

ALPHABETS = {  # Fixed values: each encoding's symbols in the order of their values, smaller alphabets first.
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_VALUE = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
_CODE = {k: np.array([v.get(chr(c), 0) for c in range(128)], np.uint8) for k, v in _VALUE.items()}
_CLASS = np.array([1 if 97 <= c < 123 else 2 if 65 <= c < 91 else 3 if 48 <= c < 58 else 0 for c in range(128)], np.uint8)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def encoding_of(token: str) -> str | None:
    body = token.rstrip("=")
    used = set(body)
    return next((k for k, v in _VALUE.items() if used <= v.keys()), None) if body else None


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_z(x: float, mean: float, var: float) -> float:
    """x of a chi-squared-like variable with this mean and variance, as a normal deviate (cube root of a scaled chi-squared)."""
    scale, df = var / (2 * mean), 2 * mean * mean / var
    return ((x / scale / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def log_binomial_tail(n: int, k: int, p: float) -> float:
    """Natural logarithm of the probability of k or more successes in n, in logarithms throughout: from the nearer side of k, until terms no longer count."""
    if k <= 0:
        return 0.0
    up = k > n * p
    at = k if up else k - 1
    first = math.lgamma(n + 1) - math.lgamma(at + 1) - math.lgamma(n - at + 1) + at * math.log(p) + (n - at) * math.log1p(-p)
    total = term = 1.0
    while term > 1e-17 * total and (at < n if up else at > 0):
        term *= (n - at) / (at + 1) * p / (1 - p) if up else at / (n - at + 1) * (1 - p) / p
        at += 1 if up else -1
        total += term
    log_sum = first + math.log(total)
    return min(0.0, log_sum) if up else math.log1p(-min(math.exp(log_sum), 1 - 1e-16))


def _serial(value: np.ndarray, step: int = 1 << 18) -> float:
    """Lag-one correlation of the values, a part at a time."""
    mean, num, den = float(value.mean()), 0.0, 0.0
    for k in range(0, len(value), step):
        v = value[k : k + step + 1].astype(float) - mean
        num += float((v[1:] * v[:-1]).sum())
        den += float((v[:step] * v[:step]).sum())
    return num / max(den, 1e-9)


def battery(token: str) -> float | None:
    """log10 of the p-value against ordinary text; None if it has no encoding or is not random in it.

    Memory is a few bytes for each character, whatever the length.
    """
    kind = encoding_of(token)
    if kind is None:
        return None
    body = np.frombuffer(token.rstrip("=").encode(), np.uint8)
    value, n, size = _CODE[kind][body], len(body), len(ALPHABETS[kind])
    chi2 = sum(c * c for c in np.bincount(value).tolist()) * size / n - n
    if 2 * _normal_tail(abs(_chi2_z(max(chi2, 1e-9), size - 1, 2 * (size - 1) * (1 - 1 / n)))) < FIT / 3:
        return None
    high = value >= size / 2
    a = int(high.sum())
    b = n - a
    if not a or not b:
        return None
    mean = 1 + 2 * a * b / n
    runs = 1 + int((high[1:] != high[:-1]).sum())
    if 2 * _normal_tail(abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))) < FIT / 3:
        return None
    if 2 * _normal_tail(abs(_serial(value) + 1 / n) * math.sqrt(n)) < FIT / 3:
        return None
    match = max(WORD_MATCH, 2.2 / size)
    extra = (n - 1) * (size * match - 1)
    z = _chi2_z(max(chi2, 1e-9), size - 1 + extra, 2 * (size - 1) + 4 * extra)
    class_ = _CLASS[body]
    least = math.log(1e-300)
    log_match = math.log(max(_normal_tail(-z), 1e-300))
    log_class = max(log_binomial_tail(n - 1, int((class_[1:] != class_[:-1]).sum()), CLASS_CHANGE), least)
    half = -log_match - log_class  # Fisher: half of a chi-squared with four degrees of freedom
    return (-half + math.log1p(half)) / math.log(10)


def pieces(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of what is tested, by start."""
    kept, at = [], 0
    for s, e, _ in spans:
        if e > at:
            kept += [text[at:s], " " * (e - max(s, at))]
            at = e
    text = "".join([*kept, text[at:]])
    out = set()
    for m in TOKEN.finditer(text):
        for v in VALUE.finditer(text, *m.span()):
            s, e = v.span()
            if e - s < CANDIDATE:
                continue
            used = set(v.group())
            if used & {"+", "/"} and used & {"-", "_"}:
                out.update(u.span() for x in UNMIXED for u in x.finditer(text, s, e) if u.end() - u.start() >= CANDIDATE)
            else:
                out.add((s, e))
    return sorted(out)


def band_of(length: int) -> int:
    return sum(length >= x for x in BANDS) - 1


def candidates(text: str, tested: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, band, bin) of the tested pieces that pass for random; a bin's p-values are rounded up."""
    out = []
    for s, e in tested:
        log_p = battery(text[s:e])
        if log_p is not None:
            out.append((s, e, band_of(e - s), min(BINS - 1, int(-log_p / BIN_WIDTH))))
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base (kind:start:end list), base_sha256, candidates and how many pieces were tested, by band."""
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches: Iterator[pa.RecordBatch]):
        for part in byte_batches(rows_of(batches), 1):
            cols = [[], [], [], [], [], [], [], []]
            for id_, text in part:
                spans = base_spans(text)
                n = Counter(k for *_, k in spans)
                base = [f"{k}:{s}:{e}" for s, e, k in spans]
                tested = pieces(text, spans)
                found = candidates(text, tested)
                runs = [0] * len(BANDS)
                for s, e in tested:
                    runs[band_of(e - s)] += 1
                for c, v in zip(cols, (id_, n["assign"], n["access"], n["hex"], base, hashlib.sha256(",".join(base).encode()).hexdigest(), [dict(zip(("start", "end", "band", "bin"), x)) for x in found], runs)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    text_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    cand = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end", "band", "bin")]))
    kinds = [to_arrow_type(source.schema["id"].dataType), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), cand, pa.list_(pa.int32())]
    names = ["id", "n_assign", "n_access", "n_hex", "base", "base_sha256", "found", "runs"]
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base array<string>, base_sha256 string, found array<struct<start:int,end:int,band:int,bin:int>>, runs array<int>"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def thresholds(scanned: DataFrame, rate: float = FDR) -> list[int]:
    """For each band of lengths the smallest bin that is added (BINS: none): Benjamini-Hochberg over all pieces tested in the corpus."""
    m = scanned.select(*[F.sum(F.col("runs")[i]).alias(f"m{i}") for i in range(len(BANDS))]).first()
    bins = scanned.select(F.explode("found").alias("f")).groupBy("f.band", "f.bin").count().collect()  # at most BANDS x BINS rows
    count = {(r[0], r[1]): r[2] for r in bins}
    out = []
    for band in range(len(BANDS)):
        at, total = BINS, 0
        for b in range(BINS - 1, -1, -1):
            total += count.get((band, b), 0)
            if total and 10 ** (-b * BIN_WIDTH) * (m[band] or 0) <= rate * total:
                at = b
        out.append(at)
    return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, n_assign, n_access, n_hex, n_random, base_sha256, spans (kind:start:end by start, comma-joined)."""
    scanned = written(scan(df, id_col, text_col))
    at = F.array(*map(F.lit, thresholds(scanned)))
    added = F.filter("found", lambda f: f["bin"] >= F.element_at(at, f["band"] + 1))
    texts = F.concat(F.col("base"), F.transform(added, lambda f: F.concat_ws(":", F.lit("random"), f["start"], f["end"])))
    keyed = F.transform(texts, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("s"), F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(x, F.lit(":"), F.lit(1))), F.lit(0)).alias("k"), x.alias("x")))
    joined = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["x"]), ",")
    return scanned.select(id_col, "n_assign", "n_access", "n_hex", F.size(added).cast("long").alias("n_random"), "base_sha256", joined.alias("spans"))
