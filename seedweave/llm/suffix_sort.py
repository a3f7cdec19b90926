"""Sorting suffixes by hashed comparisons.

The longest common extension of two suffixes is found by binary search over
prefix polynomial hashes, so a comparison takes a logarithmic number of steps
however long the common part is.  Suffixes are first put in order of their
leading bytes; those that tie are merge-sorted with such comparisons, all runs
of a round at once.  Suffixes that come out equal over ``span`` bytes are
compared byte by byte before they are believed.
"""

from __future__ import annotations

import numpy as np

from seedweave.llm.text_hash import prefix_hashes, span_hash

HEAD = 8


class SuffixSorter:
    """Suffixes of one byte array, each at least ``span`` bytes long; bytes beyond ``span`` do not count."""

    def __init__(self, data: np.ndarray, span: int):
        self.data, self.span = np.ascontiguousarray(data), span
        self.prefix = prefix_hashes(self.data)
        padded = np.concatenate([self.data, np.zeros(HEAD, np.uint8)])
        self.words = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, at most ``span``."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.span + 1, np.int64)
        equal = self._same(a, b, self.span)
        low[equal] = self.span
        open_ = np.flatnonzero(~equal)
        high[open_] = self.span
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            same = self._same(a[open_], b[open_], mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same]
            open_ = open_[high[open_] - low[open_] > 1]
        return low

    def _same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return span_hash(self.prefix, a, a + length) == span_hash(self.prefix, b, b + length)

    def before(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix a is smaller than b, and whether they are equal over the span."""
        reach = self.extension(a, b)
        equal = reach == self.span
        at = np.where(equal, 0, reach)
        return ~equal & (self.data[a + at] < self.data[b + at]), equal

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """``starts`` in the order of their suffixes; equal ones keep their order."""
        heads = self.words[starts].byteswap()
        order = starts[np.argsort(heads, kind="stable")]
        heads = self.words[order]
        edge = np.concatenate([[True], heads[1:] != heads[:-1]]) if len(order) else np.zeros(0, bool)
        group = np.cumsum(edge) - 1
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(order)))
        width = 1
        while len(size) and width < size.max():
            order = self._merge_round(order, first[group], size[group], width)
            width *= 2
        return order

    def _merge_round(self, order: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Merge neighbouring sorted runs of ``width`` inside each tie group of more than ``width``."""
        moving = np.flatnonzero(size > width)
        base, count = first[moving], size[moving]
        local = moving - base
        pair = local // (2 * width) * (2 * width)
        is_left = local - pair < width
        other = np.where(is_left, pair + width, pair)
        low = base + np.minimum(other, count)
        begin = low.copy()
        high = base + np.minimum(other + width, count)
        mine = order[moving]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            less, equal = self.before(order[mid], mine[open_])
            # Of equal suffixes those of the left run come first.
            ahead = less | (equal & ~is_left[open_])
            low[open_[ahead]] = mid[ahead] + 1
            high[open_[~ahead]] = mid[~ahead]
            open_ = open_[low[open_] < high[open_]]
        place = base + pair + (local - np.where(is_left, pair, pair + width)) + (low - begin)
        out = order.copy()
        out[place] = mine
        return out

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """Which of ``starts`` begin a string of ``span`` bytes that begins at another of them too."""
        if len(starts) < 2:
            return np.zeros(len(starts), bool)
        order = self.sort(starts)
        a, b = order[:-1], order[1:]
        close = np.flatnonzero(self._same(a, b, self.span))
        close = close[self._verified(a[close], b[close])]
        hit = np.zeros(len(self.data), bool)
        hit[a[close]] = True
        hit[b[close]] = True
        return hit[starts]

    def _verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes themselves are equal over the span."""
        same = np.ones(len(a), bool)
        for at in [*range(0, self.span - HEAD + 1, HEAD), self.span - HEAD]:
            same &= self.words[a + at] == self.words[b + at]
        return same
