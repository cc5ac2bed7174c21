"""One-permutation MinHash groups against all pairs."""

import numpy as np
import pytest
from test_jaccard import DOCS, hard_rows, plain_groups

from pagerisk.llm import minhash
from pagerisk.llm.minhash import bucket_keys, near_duplicates, signatures


@pytest.mark.parametrize("seed,percent,words,star,odd", [(1, 80, 2, 1024, 256), (2, 80, 5, 7, 3), (3, 85, 4, 16, 2)])
def test_groups(spark, monkeypatch, seed, percent, words, star, odd):
    monkeypatch.setattr(minhash, "STAR", star)
    monkeypatch.setattr(minhash, "ODD", odd)
    rows = hard_rows(seed)
    docs = spark.createDataFrame([(*r, "en", 1, "c", 2, 3) for r in rows], DOCS).repartition(5)
    got = near_duplicates(docs, words, percent).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == plain_groups(rows, words, percent)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert near_duplicates(docs.limit(0), words, percent).count() == 0


def test_star_that_falls_apart(spark, monkeypatch):
    """All sets in one bucket: the smallest is alike to few, the others are alike among themselves."""
    monkeypatch.setattr(minhash, "bucket_keys", lambda minima, rows: np.full((len(minima), 1), 7, np.int64))
    base = [f"a{i}" for i in range(30)]
    other = [f"b{i}" for i in range(30)]
    rows = [(0, " ".join(f"z{i}" for i in range(30)))]
    rows += [(i, " ".join([*base[:-1], f"x{i}"])) for i in range(1, 20)] + [(i, " ".join([*other[1:], f"y{i}"])) for i in range(20, 40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 2, 80).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == plain_groups(rows, 2, 80)


def test_signature_estimates_similarity_of_short_and_long_sets():
    rng = np.random.default_rng(5)
    for n in (5, 40, 3000):
        shares = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            sets = [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, max(1, n // 8), dtype=np.uint64)])) for _ in range(2)]
            a, b = signatures(sets, 348)
            shares.append((a == b).mean() - n / len(np.union1d(*sets)))
            assert (a < 1 << 32).all()
        assert abs(np.mean(shares)) < 0.03
    assert bucket_keys(signatures([np.arange(1, 2, dtype=np.uint64)], 12), 6).shape == (1, 2)
