"""Hashed word shingles of many texts at once, from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from crashlens.llm.shared_keys import KEY_BITS

WORDS = 5

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_WORD = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | ((_CODES >= 48) & (_CODES <= 57)) | (_CODES >= 128)
_LOWER = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint64) + np.uint64(1)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of all words in order, and the number of words before each text.

    Words are letters and digits; ASCII case is folded.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    word = _WORD[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    before = np.r_[False, word[:-1]] & ~begins[:-1]
    after = np.r_[word[1:], False] & ~begins[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * powers(_BASE, len(data)), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text, ascending, and how often each is there.

    A text of fewer than five words, but at least one, has a single shingle of all its words.
    """
    words, _, _, at = word_spans(data, offsets)
    shift = np.uint64(64 - KEY_BITS)
    n = max(len(words) - WORDS + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(WORDS):
        rolled += words[j : j + n] * _PLACES[j]
    rolled = mixed(rolled) >> shift
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1], return_counts=True))
        elif b > a:
            own = mixed(np.array([(words[a:b] * _PLACES[: b - a]).sum() + np.uint64(b - a)], np.uint64)) >> shift
            out.append((own, np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out
