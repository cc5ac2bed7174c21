"""Per-text helpers of Python workers: character statistics by numpy, Arrow columns in and out."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Python workers get this small module by value, wherever they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters of text that a task holds results of at a time.
STRETCH = 1 << 22
MODULUS = 1_000_003


def in_stretches(batches: Iterable, fn: Callable, kind: pa.DataType, stretch: int = STRETCH) -> Iterator[pa.Array]:
    """``fn`` of every row, sent on whenever ``stretch`` characters of the first column were read, however many rows a batch has."""
    for batch in batches:
        rows, held = [], 0
        for text, *more in zip(*(batch if isinstance(batch, tuple) else (batch,)), strict=True):
            text = text.as_py()
            rows.append(fn(text, *[v.as_py() for v in more]))
            held += len(text or "")
            if held >= stretch:
                yield pa.array(rows, kind)
                rows, held = [], 0
        yield pa.array(rows, kind)


def _dense(text: str) -> np.ndarray:
    """The characters as small numbers, one for each that occurs."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return codes if codes.max() < 1024 else np.unique(codes, return_inverse=True)[1]


def _bits(numbers: np.ndarray) -> float:
    n = np.bincount(numbers)
    share = n[n > 0] / len(numbers)
    return float(abs((share * np.log2(share)).sum()))


def entropy_of(text: str | None) -> float:
    return _bits(_dense(text)) if text else 0.0


def window_entropies(text: str | None, size: int, step: int) -> list[float]:
    numbers = _dense(text) if text else ()
    return [_bits(numbers[i : i + size]) for i in range(0, len(numbers), step)]


def hex_escaped(text: str | None, row: int | None, limit: int) -> str | None:
    """Letters and digits as \\xNN where the draw of their position is below ``limit``."""
    if text is None or row is None:
        return None
    i = np.arange(len(text), dtype=np.int64)
    x = (row + i * 7919) % MODULUS
    drawn = np.flatnonzero((x * x % MODULUS * 48271 + i) % MODULUS < limit)
    parts, done = [], 0
    for at in drawn.tolist():
        if category(c := text[at])[0] in "LN":
            parts += (text[done:at], f"\\x{ord(c) % 256:02x}")
            done = at + 1
    return "".join(parts) + text[done:]


def count_of(text: str | None, alphabet: str) -> int | None:
    """How many characters of the text belong to an ASCII alphabet."""
    if text is None:
        return None
    codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return int(np.bincount(codes, minlength=256)[list(alphabet.encode("ascii"))].sum())
