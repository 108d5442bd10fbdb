"""Word shingles as sorted 64-bit hashes, in numpy over a batch of whole texts."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_as_is = np.arange(1, 257, dtype=np.uint64)
_low_byte = np.arange(256, dtype=np.uint8)
_low_byte[65:91] += 32
_mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PLACE = np.uint64(0xC2B2AE3D27D4EB4F)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64, and of its inverse, at least n of each."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << n.bit_length()
        _powers, _inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers, _inverse


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = _as_is) -> np.ndarray:
    """The hash of the bytes from each start to its end, each byte as its value."""
    p, inv = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * p[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * _ODD)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: bytes of texts. The hash of each word, A-Z lower-cased, and where it starts.

    A word is lanes of eight bytes; each is mixed with its place before they are added, so the hash is no polynomial of the bytes
    and words of one pattern don't cancel.
    """
    space = _space[data]
    edge = np.diff(np.concatenate([[1], space, [1]]).astype(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(start):
        return np.zeros(0, np.uint64), start
    size = end - start
    lanes = (size + 7) // 8
    first = np.cumsum(lanes) - lanes
    word = np.repeat(np.arange(len(start)), lanes)
    k = np.arange(len(word)) - first[word]
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([_low_byte[data], np.zeros(8, np.uint8)]), 8)
    lane = eight[start[word] + 8 * k].view("<u8").reshape(-1) & _mask[np.minimum(size[word] - 8 * k, 8)]
    lane = mix(lane * _ODD + (k + 1).astype(np.uint64) * _PLACE)
    return mix(np.add.reduceat(lane, first) + size.astype(np.uint64) * _ODD), start


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted; a text of fewer words has one shingle of all, one of none has none."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts])
    w, start = word_hashes(data)
    bound = np.searchsorted(start, np.concatenate([[0], ends]))
    out = []
    full = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for i in range(words):
        full = mix(full * _ODD + w[i : i + len(full)] + np.uint64(i + 1))
    for a, b in zip(bound[:-1], bound[1:]):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for x in w[a:b]:
                h = mix(h * _ODD + x + np.uint64(77))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
