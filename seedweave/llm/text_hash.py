"""Vectorized hashing of words and byte strings inside Arrow batches.

All hashes are prefix polynomial hashes modulo 2**64: with P the prefix sums
of byte * B**i, the hash of bytes s to e is (P[e] - P[s]) * B**-s.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i up to at least ``n``."""
    if "up" not in _tables or len(_tables["up"]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P[0..n] of a byte array."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and its n + 1 offsets (null: empty)."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its five-word shingles.

    Words are lower-cased in A-Z and split at space and 0x09-0x0D.  A text with
    one to four words has its whole sequence as its one shingle.
    """
    data, offsets = text_buffer(texts)
    out: list[np.ndarray] = []
    for first, last in blocks(offsets):
        part = data[offsets[first] : offsets[last]]
        out += _sets_of(part, offsets[first : last + 1] - offsets[first])
    return out


def _sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n_docs = len(offsets) - 1
    empty = np.zeros(0, dtype=np.uint64)
    if not len(data):
        return [empty] * n_docs
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, ~word[1:]
    start = np.flatnonzero(word & (before | edge[:-1]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    hashed = mix(span_hash(prefix_hashes(_LOWER[data]), start, end) + (end - start).astype(np.uint64) * _MIX[0])
    bounds = np.searchsorted(start, offsets)  # words of document i: bounds[i] to bounds[i + 1]
    rolled = None
    if len(hashed) >= _SHINGLE:
        m = len(hashed) - _SHINGLE + 1
        rolled = np.zeros(m, dtype=np.uint64)
        for i in range(_SHINGLE):
            rolled = mix(rolled + hashed[i : i + m]) + np.uint64(i)
    out = []
    for i in range(n_docs):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if a == b:
            out.append(empty)
        elif b - a < _SHINGLE:
            whole = np.full(1, b - a, dtype=np.uint64)
            for h in hashed[a:b]:
                whole = mix(whole + h) * _MIX[1]
            out.append(whole)
        else:
            sorted_ = np.sort(rolled[a : b - _SHINGLE + 1])
            fresh = np.empty(len(sorted_), dtype=bool)
            fresh[0], fresh[1:] = True, sorted_[1:] != sorted_[:-1]
            out.append(sorted_[fresh])
    return out
