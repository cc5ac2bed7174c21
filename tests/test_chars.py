"""Character helpers of the Python workers against brute force."""

import hashlib
import math
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagerisk.functions import chars as ch
from pagerisk.functions import scripts as sc
from pagerisk.functions import text as tx

TEXTS = ["", "a", "eval(x) 0aF?", "é€😀" * 700 + "ab.*[]\\", "".join(map(chr, range(32, 5000))), None]


def bits(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def each(spark, *columns):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(TEXTS)], "id INT, x STRING")
    return [tuple(r) for r in rows.select("id", *columns).orderBy("id").collect()]


def test_micro_counters_in_one_pass(spark):
    got = each(spark, tx.count_of(F.col("x"), sc.HEX_DIGITS), sc.micro_counters(F.col("x"))["js_hi_entropy_ratio"])
    for (_, digits, ratio), s in zip(got, TEXTS, strict=True):
        assert digits == (None if s is None else sum(c in sc.HEX_DIGITS for c in s))
        assert ratio == min(255, math.floor(bits(s) / 8 * 255))


@pytest.mark.parametrize("size,step", [(1024, 512), (6, 2), (5, 5)])
def test_windows_and_their_entropy(spark, size, step):
    got = each(spark, sc.windows(F.col("x"), size, step), tx.window_entropies(F.col("x"), size, step))
    for (_, cut, values), s in zip(got, TEXTS, strict=True):
        want = [s[i : i + size] for i in range(0, len(s or ""), step)] if s else []
        assert cut == want and values == pytest.approx([bits(w) for w in want])


def test_hex_escape_by_position(spark):
    got = each(spark, sc.hex_escape(F.col("x"), F.lit("k"), 0.3, 7))
    row = int(hashlib.md5(b"7|k").hexdigest()[:15], 16) % ch.MODULUS
    for (_, made), s in zip(got, TEXTS, strict=True):
        out = None if s is None else ""
        for i, c in enumerate(s or ""):
            x = (row + i * 7919) % ch.MODULUS
            drawn = (x * x % ch.MODULUS * 48271 + i) % ch.MODULUS < int(0.3 * ch.MODULUS)
            out += f"\\x{ord(c) % 256:02x}" if drawn and unicodedata.category(c)[0] in "LN" else c
        assert made == out
    long = "ab9" * 200_000  # positions whose product passes 32 bits
    assert ch.hex_escaped(long, row, 0) == long and len(ch.hex_escaped(long, row, ch.MODULUS)) == 4 * len(long)


def test_heuristics_of_any_text(spark):
    got = each(spark, sc.heuristics(F.col("x"))["js_entropy"])
    assert [e for _, e in got] == pytest.approx([bits(s) for s in TEXTS], abs=6e-5)


def test_results_leave_in_stretches():
    rows = pa.array(["ab" * 50, None, "", "c"] * 300)
    out = list(ch.in_stretches([rows, rows.slice(0, 0)], ch.entropy_of, pa.float64(), stretch=1000))
    assert sum(len(b) for b in out) == 1200 and max(len(b) for b in out) <= 40
    assert [x for b in out for x in b.to_pylist()] == [1.0, 0.0, 0.0, 0.0] * 300
