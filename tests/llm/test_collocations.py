"""Collocations by tiles against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pagerisk.llm import collocations as co


def plain(rows, min_count, inside, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            own.update(" ".join(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            w = phrase.split(" ")
            if len(w) < 2 or a < min_count:
                continue
            if any(100 * b >= inside * a for longer, b in f.items() if b >= min_count and len(longer.split(" ")) == 3 and len(w) == 2 and f" {phrase} " in f" {longer} "):
                continue
            cuts = [(1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, phrase.encode(), phrase, left, right))
        out += [(lang, r, p, -a, left, right, n[lang], -s) for r, (s, a, _, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["é", "É", "new", "York", "city", "x" * 200]
    phrases = ["New York city", "x" * 200 + " tail end", "à la carte", "one two three four"]
    out = []
    for i in range(300):
        parts = [rng.choice(phrases) if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        out.append((rng.choice(["en", "en", "en", "fr", None, "und"]), "".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for p in parts)))
    return [*out, ("en", None), ("de", ""), ("en", " \t,.\n"), ("en", "a b " * 20_000)]


@pytest.mark.parametrize("seed,head,top", [(1, 1 << 18, 2000), (2, 12, 2000), (3, 3, 15)])
def test_counts(spark, monkeypatch, seed, head, top):
    monkeypatch.setattr(co, "HEAD", head)
    found = rows(seed)
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in found], "lang string, text string, n int, phrase string, a int").repartition(4)
    got = sorted(tuple(r) for r in co.collocations(docs, top=top).collect())
    assert got == plain(found, 10, 50, top)
    if seed == 1:
        assert co.collocations(docs.limit(0)).count() == 0


def test_tiles_count_like_a_dictionary(monkeypatch):
    monkeypatch.setattr(co, "CROWD", 40)
    monkeypatch.setattr(co, "HELD", 2000)
    rng = np.random.default_rng(2)
    tiles, want = co.PairTiles(), Counter()
    for _ in range(5):
        left, right = (np.minimum(rng.zipf(1.3, 4000), 300_000) for _ in range(2))
        tiles.add(left, right, dense=2)
        want.update(zip(left.tolist(), right.tolist(), strict=True))
    assert len(tiles.dense) == 2
    left, right, counts = tiles.take()
    assert dict(zip(zip(left.tolist(), right.tolist(), strict=True), counts.tolist(), strict=True)) == want and not tiles.dense
