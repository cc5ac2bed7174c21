"""Suffix arrays of byte strings, refined as by Larsson and Sadakane, with capped common prefixes as by Kasai."""

from __future__ import annotations

import numpy as np

_FIRST = 4  # bytes sorted at once: with the place they fit one integer, which sorts faster than an order


def _order(major: np.ndarray, minor: np.ndarray, bits: int) -> np.ndarray:
    """Stable order by (major, minor), numbers below 2^bits each; one plain sort where all fits 63 bits."""
    wide = max(1, int(len(major) - 1).bit_length())
    if 2 * bits + wide <= 63:
        return np.sort((major.astype(np.int64) << (bits + wide)) | (minor.astype(np.int64) << wide) | np.arange(len(major))) & ((1 << wide) - 1)
    return np.lexsort((minor, major))


def suffix_groups(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes, and for each suffix the number of its group of equals there.

    Only groups that still tie are refined: by the group of the suffix h bytes
    on, with h doubling up to the depth. A suffix that ends stands before its extensions.
    """
    n = len(text)
    wide = max(1, int(n - 1).bit_length()) if n else 1
    if n and depth >= 8 and text.all():
        # Without zero bytes, zeros behind the end are like no other suffix: eight bytes sort as one number.
        h, key = 8, np.ndarray((n,), ">u8", np.append(text, np.zeros(8, np.uint8)), 0, (1,)).astype(np.uint64)
        array = np.argsort(key)
        key = key[array]
        same = key[1:] == key[:-1]
    else:
        h, key = _FIRST, np.zeros(n, np.int64)
        for k in range(_FIRST):
            key[: n - k] += (text[k:].astype(np.int64) + 1) << (9 * (_FIRST - 1 - k)) if n > k else 0
        if 9 * _FIRST + wide <= 63:
            packed = np.sort((key << wide) | np.arange(n))
            array, same = packed & ((1 << wide) - 1), (packed >> wide)[1:] == (packed >> wide)[:-1]
        else:
            array = np.argsort(key, kind="stable")
            same = key[array][1:] == key[array][:-1]
    group = np.zeros(n + 1, np.int64)  # of each suffix: the place where its group begins, plus one; 0 behind the end
    starts = np.concatenate([[True], ~same]) if n else np.zeros(0, bool)
    group[array] = np.maximum.accumulate(np.where(starts, np.arange(n), 0)) + 1
    bits = max(1, int(n + 1).bit_length())
    while h < depth:
        tied = np.zeros(n, bool)
        tied[1:] = ~starts[1:]
        tied[:-1] |= ~starts[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        step = min(h, depth - h)
        own = array[at]
        first, second = group[own], group[np.minimum(own + step, n)]
        order = _order(first, second, bits)
        own, first, second = own[order], first[order], second[order]
        array[at] = own
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        starts[at] = new
        group[own] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        h += step
    return array, group[:n]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes, and the place of each suffix in that order."""
    array, _ = suffix_groups(text, depth)
    rank = np.empty(len(text), np.int64)
    rank[array] = np.arange(len(text))
    return array, rank


def common_prefixes(text: np.ndarray, array: np.ndarray, rank: np.ndarray, cap: int, lanes: int = 32768) -> np.ndarray:
    """For each place in the array the common prefix with the suffix before it, ``cap`` (the array's depth or less) at most.

    Kasai's walk in text order, where the length falls by one at most from a
    suffix to the next, done for many stretches of the text at once.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    stride = -(-n // min(lanes, n))
    starts = np.arange(0, n, stride)
    length = np.zeros(len(starts), np.int64)
    for step in range(stride):
        i = starts + step
        if i[-1] >= n:
            i, length = i[:-1], length[:-1]
            starts = starts[:-1]
            if not len(i):
                break
        # Suffixes that tie stand in any order, so nothing follows from a prefix that reached the cap.
        length = np.where(length == cap, 0, np.maximum(length - 1, 0))
        place = rank[i]
        j = array[np.maximum(place - 1, 0)]
        most = np.where(place > 0, np.minimum(cap, n - np.maximum(i, j)), 0)
        length = np.minimum(length, most)
        open_ = np.flatnonzero(length < most)
        while len(open_):
            at = length[open_]
            differ = words[i[open_] + at] ^ words[j[open_] + at]
            low = differ == 0
            # Number of equal low bytes, by halving.
            equal = np.where((differ & np.uint64(0xFFFFFFFF)) == 0, 4, 0)
            rest = differ >> (equal * 8).astype(np.uint64)
            two = np.where((rest & np.uint64(0xFFFF)) == 0, 2, 0)
            rest >>= (two * 8).astype(np.uint64)
            equal = np.where(low, 8, equal + two + ((rest & np.uint64(0xFF)) == 0))
            length[open_] = np.minimum(at + equal, most[open_])
            open_ = open_[low & (length[open_] < most[open_])]
        out[place] = length
    return out
