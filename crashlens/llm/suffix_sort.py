"""Suffix sort of byte strings in groups: mergesort whose comparisons find the common extension by prefix hashes.

A comparison of two strings is a binary search for the length up to which their hashes agree, so it takes the logarithm of the
length, and one look at the bytes that follow. All groups are sorted together, step by step.
"""

from __future__ import annotations

import numpy as np

from crashlens.llm.anchors import WINDOW, Prefixes
from crashlens.llm.shingles import mixed


def compare(prefixes: Prefixes, x: np.ndarray, y: np.ndarray, x_length: np.ndarray, y_length: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for each pair of strings, given by place and length."""
    limit = np.minimum(x_length, y_length)
    out = np.sign(x_length - y_length)
    differ = np.flatnonzero(prefixes.of(x, limit) != prefixes.of(y, limit))
    if len(differ):
        x, y = x[differ], y[differ]
        low, high = np.zeros(len(differ), np.int64), limit[differ] - 1  # the common length is in this range
        base_x, base_y = prefixes.sums[x], prefixes.sums[y]
        scale_x, scale_y = prefixes.down[x], prefixes.down[y]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = (prefixes.sums[x + middle] - base_x) * scale_x == (prefixes.sums[y + middle] - base_y) * scale_y
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[differ] = np.where(prefixes.data[x + low] < prefixes.data[y + low], -1, 1)
    return out


def sort_in_groups(prefixes: Prefixes, place: np.ndarray, length: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The order that sorts the strings in each group; the groups begin at ``starts`` and follow one another."""
    sizes = np.diff(np.r_[starts, len(place)])
    start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    inside = np.arange(len(place)) - start
    order, width = np.arange(len(place)), 1
    while width < sizes.max(initial=0):
        act = np.flatnonzero(size > width)
        block = start[act] + inside[act] // (2 * width) * (2 * width)
        offset = act - block
        left = offset < width
        end = start[act] + size[act]
        first = np.where(left, np.minimum(block + width, end), block)
        low, high = first.copy(), np.where(left, np.minimum(block + 2 * width, end), block + width)
        item = order[act]
        search = np.flatnonzero(low < high)
        while len(search):
            middle = (low[search] + high[search]) >> 1
            other, own = order[middle], item[search]
            sign = compare(prefixes, place[other], place[own], length[other], length[own])
            before = (sign < 0) | ((sign == 0) & ~left[search])
            low[search[before]] = middle[before] + 1
            high[search[~before]] = middle[~before]
            search = search[low[search] < high[search]]
        moved = order.copy()
        moved[block + np.where(left, offset, offset - width) + low - first] = item
        order, width = moved, 2 * width
    return order


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether two strings of the same length, at least a window, are equal byte by byte."""
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    same = np.ones(len(x), bool)
    for done in range(0, int(length.max(initial=0)), WINDOW):
        open_ = np.flatnonzero(same & (length > done))
        at = np.minimum(done, length[open_] - WINDOW)
        same[open_] = (windows[x[open_] + at] == windows[y[open_] + at]).all(axis=1)
    return same


def _candidates(
    prefixes: Prefixes, place: np.ndarray, length: np.ndarray, group: np.ndarray, owner: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings to sort, and strings that repeat one of them in the same document, with that one.

    A string of whose hash there is no other in its group is equal to none and is left out.
    """
    salt = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64)
    told = mixed(prefixes.of(place, length) ^ mixed(salt))
    order = np.lexsort((owner, told))
    told, owner = told[order], owner[order]
    same = told[1:] == told[:-1]
    held = np.r_[same, False] | np.r_[False, same]
    again = np.r_[False, same & (owner[1:] == owner[:-1])]
    first = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
    repeats = np.flatnonzero(again)
    repeats = repeats[same_bytes(prefixes.data, place[order[repeats]], place[first[repeats]], length[order[repeats]])]
    held[repeats] = False
    return np.sort(order[held]), order[repeats], first[repeats]


def classes(prefixes: Prefixes, place: np.ndarray, length: np.ndarray, group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A class number for each string: equal for equal strings of a group (``group`` ascending), else different.

    Only strings that can be equal to one of another document (``owner``) are sorted, a repeated one of a document once. Neighbours
    in the sorted order whose hashes agree are compared byte by byte, so a collision of hashes joins nothing.
    """
    number = np.arange(len(place))
    if not len(place):
        return number
    chosen, repeats, repeated = _candidates(prefixes, place, length, group, owner)
    place, length, group = place[chosen], length[chosen], group[chosen]
    if not len(place):
        return number
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    order = sort_in_groups(prefixes, place, length, starts)
    x, y = order[:-1], order[1:]
    same = (group[x] == group[y]) & (length[x] == length[y])
    at = np.flatnonzero(same)
    at = at[prefixes.of(place[x[at]], length[x[at]]) == prefixes.of(place[y[at]], length[y[at]])]
    same[:] = False
    same[at[same_bytes(prefixes.data, place[x[at]], place[y[at]], length[x[at]])]] = True
    first = np.flatnonzero(np.r_[True, ~same])
    number[chosen[order]] = np.repeat(chosen[order[first]], np.diff(np.r_[first, len(order)]))
    number[repeats] = number[repeated]
    return number


def _least(values: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The smallest value of each class, for each member."""
    least = np.full(int(number.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, values)
    return least[number]


def earlier_windows(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For strings (segments) of the keys given, ascending: windows that a segment of smaller id has too.

    Returns the segment and the place in it of each such window. Segments are sorted as wholes first; equal ones count once,
    and only where a key has several different ones are their windows sorted, by key and place of the key in the window.
    """
    prefixes = Prefixes(data)
    begin, length = offsets[:-1], np.diff(offsets)
    whole = classes(prefixes, begin, length, keys, ids)
    first_id = _least(ids, whole)
    one = np.flatnonzero(whole == np.arange(len(whole)))  # a class has the number of one of its segments
    lone = np.flatnonzero(np.r_[True, keys[one][1:] != keys[one][:-1]])
    several = one[np.repeat(np.diff(np.r_[lone, len(one)]) > 1, np.diff(np.r_[lone, len(one)]))]

    # Windows of the different segments, in groups by key and by the place of the key's gram.
    many = length[several] - WINDOW + 1
    segment = np.repeat(several, many)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(many) - many, many)
    place = begin[segment] + inside
    grams = prefixes.grams()
    hit = np.full(len(data) + 1, len(data), np.int64)
    owner = np.repeat(np.arange(len(keys)), length)[: len(grams)]
    at = np.flatnonzero(grams == keys[owner])
    hit[at] = at
    gram = np.minimum.accumulate(hit[::-1])[::-1][place] - place
    order = np.lexsort((gram, keys[segment]))
    segment, inside, place, gram = segment[order], inside[order], place[order], gram[order]
    new = np.r_[True, (keys[segment][1:] != keys[segment][:-1]) | (gram[1:] != gram[:-1])][: len(segment)]
    group = np.cumsum(new)
    size = np.bincount(group)[group] if len(group) else group
    shared = size > 1
    segment, inside, place, group = segment[shared], inside[shared], place[shared], group[shared]
    number = classes(prefixes, place, np.full(len(place), WINDOW), group, ids[segment])
    first = _least(first_id[segment], number)

    # Back to all segments: the smallest id of each window of a class of segments.
    base = np.zeros(len(keys), np.int64)
    base[several] = np.cumsum(many) - many
    by_class = np.full(int(whole.max(initial=-1)) + 1, -1)
    by_class[whole[several]] = several
    leasts = np.repeat(first_id[several], many)
    leasts[base[segment] + inside] = np.minimum(first, leasts[base[segment] + inside])
    n = length - WINDOW + 1
    owner = np.repeat(np.arange(len(keys)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    model = by_class[whole[owner]]
    least = np.where(model >= 0, leasts[np.minimum(base[model] + inside, max(len(leasts) - 1, 0))] if len(leasts) else 0, first_id[owner])
    found = np.flatnonzero(least < ids[owner])
    return owner[found], inside[found]
