"""Words of letters and digits, cut from whole Arrow columns of text.

A word is a maximal run of 0-9, A-Z, a-z and characters above 0x7F; only A-Z
is lower-cased.  In UTF-8 all bytes of such a character are above 0x7F, so
bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from seedweave.llm.text_hash import blocks, text_buffer

BLOCK_BYTES = 1 << 20

# The byte that stands for each byte inside a word; 0 for bytes between words.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
_FOLDED[0x41:0x5B] += 32


def _cut_point(data: np.ndarray, at: int, end: int) -> int:
    """First place from ``at`` on that lies between words, or ``end``."""
    while at < end:
        gap = np.flatnonzero(_FOLDED[data[at : min(at + 4096, end)]] == 0)
        if len(gap):
            return at + int(gap[0])
        at += 4096
    return end


def word_blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each word, words) of about ``most`` bytes of text at a time, rows ascending (null: no word).

    A text longer than ``most`` comes in several blocks that are cut between
    words, so memory does not grow with the longest text.
    """
    data, offsets = text_buffer(texts)
    for first, last in blocks(offsets, most):
        if last - first > 1 or offsets[last] - offsets[first] <= most:
            yield _words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
            continue
        begin, end = int(offsets[first]), int(offsets[last])
        while begin < end:
            stop = _cut_point(data, min(begin + most, end), end)
            yield _words(data[begin:stop], np.array([0, stop - begin]), first)
            begin = stop


def _words(data: np.ndarray, offsets: np.ndarray, row: int) -> tuple[np.ndarray, pa.Array]:
    folded = _FOLDED[data]
    inside = folded != 0
    if not inside.any():
        return np.zeros(0, np.int64), pa.array([], pa.string())
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    start = np.flatnonzero(opens)
    own = folded[inside]
    # Bytes of words end to end: a word ends where the next one starts.
    place = (np.cumsum(inside) - 1)[start]
    ends = np.append(place, len(own)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(own)])
    return row + np.searchsorted(offsets, start, side="right") - 1, words
