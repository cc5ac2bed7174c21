"""Ranked search with block skipping against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from pagerisk.llm import lexical
from pagerisk.llm.lexical import Asked, Best, blocks, ranked_search, search_shard, terms_of

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    words = [(i, plain_terms(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, w in words:
            if not w:
                continue
            m = 100 - 50 + (50 * len(w) * n_docs) // length
            score = 0
            for t in terms & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(seed, n):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(800)]
    prose = lambda k: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(k))
    items = [(i, prose(rng.randint(3, 25))) for i in range(12)] + [(3, "Extra_ÉTÉ c1"), (50, None), (51, "?!"), (None, "c1 r5")]
    docs = [(i, prose(rng.randint(1, 120))) for i in range(n)]
    docs += [(n + i, f"{prose(4)} {items[i % 12][1]}, {prose(4)}") for i in range(60)]
    docs += [(n + 200, None), (n + 201, ""), (n + 202, "x " * 30_000 + "c1"), (None, docs[3][1]), (7, docs[7][1]), (7, docs[7][1]), (n + 203, "été, ETE; ÉTÉ")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed,n,k,cells,sample", [(1, 400, 5, 1 << 23, 50), (2, 300, 50, 20_000, 16_384), (3, 60, 200, 5_000, 10)])
def test_ranking(spark, monkeypatch, seed, n, k, cells, sample):
    monkeypatch.setattr(lexical, "SAMPLE", sample)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 400 if seed == 3 else 1 << 20)
    docs, items = rows(seed, n)
    frame = spark.createDataFrame([(*d, "en", 1) for d in docs], "doc_id bigint, text string, item_id string, score int").repartition(4)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id bigint, text string, rank int")
    got = sorted((tuple(r) for r in ranked_search(frame, asked, k).collect()), key=str)
    assert got == plain_search(docs, items, k)
    assert ranked_search(frame.limit(0), asked, k).count() == 0 == ranked_search(frame, asked.limit(0), k).count()


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(3)
    kinds = np.zeros((100, 200))
    for i in range(100):
        kinds[i, rng.choice(20, 8, replace=False) + i % 10 * 20] = rng.integers(1, 1000, 8)
    vectors = np.floor(kinds[np.arange(4000) % 100] * rng.uniform(0.9, 1, (4000, 200)))
    asked = Asked([list(range(t * 20, t * 20 + 12)) for t in range(10)], np.ones(200, np.int64), 4000, 32_000, 10)
    best = Best(asked, np.zeros(10, np.int64))
    projection = np.random.default_rng(1).standard_normal((200, 16))
    ids = np.arange(4000)
    search_shard(asked, best, ids[:400], vectors[:400], projection)
    scored = search_shard(asked, best, ids[400:], vectors[400:], projection)
    assert scored < 0.4 * 3600
    for i, terms in enumerate(asked.items):
        whole = vectors[:, terms].sum(axis=1).astype(np.int64)
        order = np.lexsort((ids, -whole))[:10]
        assert best.ids[i].tolist() == order.tolist() and best.scores[i].tolist() == whole[order].tolist()
    order, starts = blocks(rng.standard_normal((100, 16)))
    assert sorted(order.tolist()) == list(range(100)) and starts[0] == 0
    assert terms_of("A-b_É9 x") == ["a".encode(), b"b", "É9 x".encode()]
