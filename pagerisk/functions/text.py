"""Character-level string expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagerisk.functions import chars as ch

# Alphabets of the character encoders (index 0 pads, 1 is unknown).
LETTERS = "abcdefghijklmnopqrstuvwxyz" "ABCDEFGHIJKLMNOPQRSTUVWXYZ" "0123456789"
URL_ALPHABET = LETTERS + ":/?#[]@!$&'()*+,;=%._-~"
JS_ALPHABET = LETTERS + "{}[]()<>;:,.!@#$%^&*-_=+|\\/\"'`?\n\r\t "
TEXT_ALPHABET = LETTERS + " -_.:,;!?/'\"()[]{}@#%&*+=<>|\\\n\t"
TITLE_CHARS = 256
URL_SEQ_CHARS = 256
JS_SEQ_CHARS = 2048


def chars(s: Column) -> Column:
    """Code points of a string as an array."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def ngrams(s: Column, n: int) -> Column:
    """Overlapping character n-grams, empty for short strings."""
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: s.substr(i, F.lit(n)))
    return F.when(F.length(s) >= n, grams).otherwise(F.array().cast("array<string>"))


def short_entropy(s: Column) -> Column:
    """C4 for URLs and the like: the count of each distinct character is the length lost by removing it."""
    n = F.length(s)
    share = F.transform(F.array_distinct(chars(s)), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    bits = F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


@cache
def _entropy():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from ch.in_stretches(batches, ch.entropy_of, pa.float64())

    return F.arrow_udf(run, "DOUBLE")


def entropy(s: Column) -> Column:
    """C4: Shannon entropy in bits per character, 0 for an empty string; one pass over the text, whatever its alphabet."""
    return _entropy()(s)


@cache
def _count_of(alphabet: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from ch.in_stretches(batches, lambda s: ch.count_of(s, alphabet), pa.int32())

    return F.arrow_udf(run, "INT")


def count_of(s: Column, alphabet: str) -> Column:
    """How many characters belong to an ASCII alphabet that does not hold the question mark."""
    return _count_of(alphabet)(s)


@cache
def _window_entropies(size: int, step: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from ch.in_stretches(batches, lambda s: ch.window_entropies(s, size, step), pa.list_(pa.float64()))

    return F.arrow_udf(run, "ARRAY<DOUBLE>")


def window_entropies(s: Column, size: int = 1024, step: int = 512) -> Column:
    """C4 of each overlapping window, in order."""
    return _window_entropies(size, step)(s)


def encode(s: Column, alphabet: str, max_len: int | None = None) -> Column:
    """Index sequence over an alphabet, unknown characters are 1; ``max_len`` is the fixed model width."""
    text = s if max_len is None else F.substring(s, 1, max_len)
    if alphabet.isascii():  # constant-time lookup by code point
        slots = [1] * 128
        for i, ch in enumerate(alphabet):
            slots[ord(ch)] = i + 2
        table = F.array(*[F.lit(v) for v in slots])
        return F.transform(chars(text), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(1)))
    at = lambda c: F.instr(F.lit(alphabet), c)
    return F.transform(chars(text), lambda c: F.when(at(c) > 0, at(c) + 1).otherwise(F.lit(1)))


def decode(seq: Column, alphabet: str) -> Column:
    """Text of an index sequence; pad and unknown vanish."""
    known = F.filter(seq, lambda i: (i >= 2) & (i < len(alphabet) + 2))
    return F.array_join(F.transform(known, lambda i: F.lit(alphabet).substr(i - 1, F.lit(1))), "")


def code_points(s: Column, modulus: int = 256, max_len: int | None = None) -> Column:
    """Code point of every character modulo ``modulus``."""
    text = s if max_len is None else F.substring(s, 1, max_len)
    return F.transform(chars(text), lambda c: F.pmod(F.ascii(c), F.lit(modulus)))


def sorted_pairs(m: Column) -> Column:
    """Entries of a map ordered by key."""
    return F.array_sort(F.map_entries(m))


def hash60(s: Column) -> Column:
    """Stable 60-bit hash, NULL for NULL."""
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def collapse(s: Column) -> Column:
    """Whitespace runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def top_ngrams(df: DataFrame, key: str, text: str, n: int = 3, keep: int = 500) -> DataFrame:
    """The ``keep`` commonest n-grams per row with their share of the kept total.

    Rows are as many as the text of one URL has characters, so the rank per key stays small.
    """
    grams = df.select(key, F.explode(ngrams(F.lower(F.trim(F.col(text))), n)).alias("gram"))
    counts = grams.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    ranked = counts.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("n"), "gram"))).filter(F.col("_rn") <= keep)
    return ranked.select(key, "gram", "n", (F.col("n") / F.sum("n").over(w)).alias("share"))
