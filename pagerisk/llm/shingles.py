"""Hashed sets of word shingles, computed over whole batches of texts."""

from __future__ import annotations

import numpy as np

from pagerisk.llm.common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = 1 << 16
# A random 64-bit value for each byte, upper-case letters taking those of lower case.
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


_POWERS = {base: _powers(base, _STEP) for base in (_BASE, _INVERSE)}


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z in lower case) of every text, and the number of words in each text."""
    # A space behind every text keeps words apart.
    n = np.diff(offsets)
    padded = np.full(len(data) + len(n), 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(len(n)), n)] = data
    ends_of_texts = offsets[1:] + np.arange(1, len(n) + 1)
    inside = ~_SPACE[padded]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        # Sum of value * base^(place within its step), all steps alike: words over a step's border are hashed apart below.
        places = np.arange(len(padded), dtype=np.int64) & (_STEP - 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[padded] * _POWERS[_BASE][places], dtype=np.uint64)])
        out = mix64((sums[ends] - sums[starts]) * _POWERS[_INVERSE][starts & (_STEP - 1)])
        for w in np.flatnonzero(starts // _STEP != (ends - 1) // _STEP):
            word = _VALUES[padded[starts[w] : ends[w]]]
            whole = np.uint64(0)
            shift = np.uint64(1)
            for lo in range(0, len(word), _STEP):
                part = word[lo : lo + _STEP]
                whole += np.sum(part * _POWERS[_BASE][: len(part)], dtype=np.uint64) * shift
                shift *= _POWERS[_BASE][-1] * _BASE
            out[w] = mix64(np.array([whole], np.uint64))[0]
    return out, np.diff(np.searchsorted(starts, np.concatenate([[0], ends_of_texts])))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its shingles of ``words`` words.

    A text with fewer words has its whole sequence as one shingle, a text
    without words none.
    """
    hashes, counts = word_hashes(data, offsets)
    at = np.concatenate([[0], np.cumsum(counts)])
    factors = mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - words + 1)
        joined = np.zeros(n, np.uint64)
        for k in range(words):
            joined += hashes[k : k + n] * factors[k]
        joined = mix64(joined)
        out = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo >= words:
                out.append(np.unique(joined[lo : hi - words + 1]))
            elif hi > lo:
                short = np.sum(hashes[lo:hi] * factors[: hi - lo], dtype=np.uint64) + np.uint64(hi - lo)
                out.append(mix64(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
