"""Words, word hashes and word shingles of many texts at once, on numpy arrays."""

from __future__ import annotations

import numpy as np

#: White space that separates words: space, tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything but ASCII letters, digits and bytes of longer characters.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_draw = np.random.Generator(np.random.PCG64(20240229))
_EXACT = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE = _EXACT.copy()
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z hash as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _draw.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each input bit stirs all output bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def find_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n+1 offsets that say which words are each text's."""
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z unless `fold` is false."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    flat_start = np.zeros(len(starts), np.int64)
    np.cumsum(length[:-1], out=flat_start[1:])
    place = np.arange(int(length.sum())) - np.repeat(flat_start, length)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(length.max()), _STEP)]))
    parts = (_BYTE if fold else _EXACT)[data[np.repeat(starts, length) + place]] * powers[place]
    return mix(np.add.reduceat(parts, flat_start) + length.astype(np.uint64))


def hash_shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of `size` words inside a text, in order, and n+1 offsets.

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    n = np.diff(bounds)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    if not len(words):
        return np.zeros(0, np.uint64), offsets
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    at = np.arange(offsets[-1]) + np.repeat(bounds[:-1] - offsets[:-1], counts)
    left = np.repeat(np.minimum(n, size), counts)
    total = left.astype(np.uint64)
    for k in range(size):
        part = padded[at + k] * _PLACE[k]
        total = total + (part if k == 0 else np.where(left > k, part, np.uint64(0)))
    return mix(total), offsets
