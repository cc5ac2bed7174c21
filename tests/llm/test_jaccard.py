"""The size-aware Jaccard join against all pairs, and components against a plain search."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagerisk.llm import jaccard
from pagerisk.llm.common import utf8
from pagerisk.llm.components import connected
from pagerisk.llm.jaccard import least_share, light_boundary, overlaps, similar_groups
from pagerisk.llm.shingles import _STEP, shingle_sets, word_hashes

DOCS = "doc_id bigint, text string, lang string, n_shingles int, component_id string, center int, a int"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def plain_set(text, k):
    w = plain_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_groups(rows, k, percent):
    sets = [(i, plain_set(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10_000)}"
    return out


def hard_rows(seed):
    rng = random.Random(seed)
    prose = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "One  two\nthree", "a b c d", "a b c d e", "é É", "É é"]
    for n in (5, 8, 12, 17, 25, 60, 200, 500):
        base = prose(n)
        for _ in range(12):
            texts.append(" ".join(edited(rng, base, rng.randint(0, max(1, n // 40)))))
            texts.append(" ".join(base[: rng.randint(int(0.8 * n), n)]))
    licence = prose(30)
    texts += [" ".join(prose(rng.randint(5, 60)) + licence) for _ in range(40)]
    near = prose(120)
    texts += [" ".join(edited(rng, near, 2)) for _ in range(80)]
    texts += [texts[30]] * 50
    rng.shuffle(texts)
    return [*enumerate(texts), (None, texts[30]), (None, None), (5000, "x " * 40_000)]


@pytest.mark.parametrize("seed,percent,words,short,group", [(1, 85, 4, 64, 1024), (2, 80, 5, 3, 7), (3, 85, 4, 1, 16)])
def test_groups(spark, monkeypatch, seed, percent, words, short, group):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard.heavy_links, "__defaults__", (group,))
    rows = hard_rows(seed)
    docs = spark.createDataFrame([(*r, "en", 1, "c", 2, 3) for r in rows], DOCS).repartition(5)
    got = sorted((tuple(r) for r in similar_groups(docs, words, percent).collect()), key=str)
    assert got == plain_groups(rows, words, percent)
    assert similar_groups(docs.limit(0), words, percent).count() == 0


def test_repeated_rows_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    assert sorted(map(tuple, similar_groups(docs, 4, 85).collect())) == [(1, 3, 1), (1, 3, 1), (2, 3, 1)]


def test_shingle_sets_equal_plain_ones():
    rng = random.Random(9)
    alphabet = ["a", "B", "b", " ", "\t", "\n", "\x0b", "\x0c", "\r", "é", "É", " ", "\x1c", "1"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["q" * (_STEP + 5), "x " + "q" * (2 * _STEP) + " y", "q" * (_STEP + 5) + " q"]
    names, seen = {}, {}
    for text, own in zip(texts, shingle_sets(*utf8(pa.array(texts)), 3), strict=True):
        plain = plain_set(text, 3)
        assert len(own) == len(plain)
        assert names.setdefault(frozenset(plain), own.tobytes()) == own.tobytes()
        assert seen.setdefault(own.tobytes(), frozenset(plain)) == frozenset(plain)
    hashes, counts = word_hashes(*utf8(pa.array(texts)))
    words = [w for t in texts for w in plain_words(t)]
    assert counts.tolist() == [len(plain_words(t)) for t in texts]
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist(), strict=True)))


def test_overlaps_and_bounds():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 5000, n).astype(np.uint64)) for n in (0, 1, 30, 3000, 4000)]
    got = overlaps(sets, sets[::-1])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]
    assert least_share(20, 85) == 17 and least_share(7, 85) == 6
    assert 5 < light_boundary({n: 10 for n in range(1, 41)}, 85) < 30 and light_boundary({}, 85) == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(300)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    got = connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((i, root(i)) for i in parent)
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rows_of_postings_do_not_grow_with_the_slices(spark, monkeypatch):
    """A task sends one row to each range, however many slices of text it reads, and light sets are not read from text again."""
    counts, whole = {}, type(spark.range(0)).mapInArrow

    def counted(self, fn, schema, *rest):
        out = whole(self, fn, schema, *rest)
        counts.setdefault(schema, []).append((out.count(), self.columns))
        return out

    monkeypatch.setattr(jaccard, "_TEXT_BYTES", 1000)
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counted)
    rows = hard_rows(4)
    docs = spark.createDataFrame([(*r, "en", 1, "c", 2, 3) for r in rows], DOCS).repartition(5)
    got = sorted((tuple(r) for r in similar_groups(docs, 4, 85).collect()), key=str)
    assert got == plain_groups(rows, 4, 85)
    (postings, _), = counts["part int, tokens binary, owners binary, places binary, nodes binary"]
    (subsets, columns), = counts["key bigint, s bigint, n bigint, doc_id bigint"]
    assert 0 < postings <= 5 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert subsets and "text" not in columns
