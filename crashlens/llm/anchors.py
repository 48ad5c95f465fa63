"""Anchor keys: which part of a text a window of bytes belongs to, by the bytes in it only.

The key of a ``WINDOW``-byte string is the smallest hash of the ``GRAM``-byte strings in it. Equal windows have equal keys, so two texts
that share a window share a key, and consecutive windows mostly have the same one: a run of about sixteen.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from crashlens.llm.shared_keys import KEY_BITS
from crashlens.llm.shingles import mixed

WINDOW, GRAM = 50, 20
PLACES = WINDOW - GRAM + 1

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Prefixes:
    """Prefix polynomial hashes of a buffer, modulo 2 ** 64: the hash of any part is had from two of them."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = _powers(1 << max(20, len(data).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.down[at]

    def grams(self) -> np.ndarray:
        """A key for each ``GRAM``-byte string."""
        n = max(len(self.data) - GRAM + 1, 0)
        return mixed((self.sums[GRAM : GRAM + n] - self.sums[:n]) * self.down[:n]) >> np.uint64(64 - KEY_BITS)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all texts in ``data``: key, first window, last window and text of each run of windows of the same key.

    Every window of every text is in one run; texts shorter than a window have none.
    """
    n, none = len(data) - WINDOW + 1, np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    least, span = Prefixes(data).grams(), 1
    while 2 * span <= PLACES:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[PLACES - span : PLACES - span + n])
    ends = np.maximum(offsets[1:] - WINDOW + 1, offsets[:-1])
    change = np.zeros(n + 1, bool)
    change[0] = True
    change[1:-1] = least[1:] != least[:-1]
    full = ends > offsets[:-1]
    change[offsets[:-1][full]] = True
    change[np.minimum(ends, n)] = True
    first = np.flatnonzero(change[:n])
    last = np.r_[first[1:], n] - 1
    text = np.searchsorted(offsets, first, side="right") - 1
    inside = first < ends[text]
    first, last, text = first[inside], last[inside], text[inside]
    return least[first], first, last, text
