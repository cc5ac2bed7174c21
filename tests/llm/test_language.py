"""Code lengths against a plain context tree, and accuracy on held-out documents."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pagerisk.llm.common import utf8
from pagerisk.llm.language import UNIT, Trees, identify_languages, predict, train

SF = "/root/testdata/sf0.01"


def plain_length(text: bytes, training: dict[str, list[bytes]], lang: str) -> float:
    """PPM with escapes, without exclusion, contexts of three bytes at most, texts behind three zero bytes."""
    everything = collections.Counter()
    own = collections.Counter()
    for name, texts in training.items():
        for t in texts:
            t = b"\0\0\0" + t
            for i in range(3, len(t)):
                everything[t[i - 3 : i + 1]] += 1
                own[t[i - 3 : i + 1]] += name == lang
    counts = [collections.defaultdict(collections.Counter) for _ in range(4)]
    for gram, n in own.items():
        for k in range(4):
            counts[k][gram[3 - k : 3]][gram[3]] += n
    known = {g[1:] for g in everything}  # contexts of three bytes that have children in the trie

    def cost(context: bytes, symbol: int) -> float:
        table = {s: n for s, n in counts[len(context)][context].items() if n}
        if len(context) == 3 and context not in known:
            table = {}
        total, kinds = sum(table.values()), len(table)
        if table.get(symbol):
            return -math.log2(table[symbol] / (total + kinds))
        leave = -math.log2(kinds / (total + kinds)) if total else 0.0
        return leave + (cost(context[1:], symbol) if context else 8.0)

    padded = b"\0\0\0" + text
    return sum(cost(padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))


def test_code_lengths():
    rng = random.Random(4)
    training = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))).encode() for _ in range(8)] for lang, letters in (("aa", "abé "), ("bb", "bcd "))}
    counts = collections.defaultdict(lambda: [0, 0])
    for k, texts in enumerate(training.values()):
        for t in texts:
            t = b"\0\0\0" + t
            for i in range(3, len(t)):
                counts[int.from_bytes(t[i - 3 : i + 1], "big")][k] += 1
    grams = sorted(counts)
    trees = Trees(["aa", "bb"], np.array(grams), np.array([counts[g] for g in grams]))
    texts = ["", "a", "ab", "abc", "zzz", "dcb abé", "b" * 50, "\0\0\0a", *("".join(rng.choice("abcdé ") for _ in range(30)) for _ in range(20))]
    got = trees.lengths(*utf8(pa.array(texts))) / UNIT
    want = [[plain_length(t.encode(), training, lang) for lang in training] for t in texts]
    assert got == pytest.approx(np.array(want), abs=0.02)


def test_held_out_accuracy_and_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert set(got) == set(truth) and 150 < len(held) < 350
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_hard_rows(spark):
    schema = "doc_id bigint, text string, lang string, letters boolean, score int, n int"
    data = [(None, None, None), (1, "", "xx"), (2, "12 !!", "xx"), (3, "the cat sat", "en"), (3, "the cat sat", "en"), (4, "der hund", "de"), (5, None, "de"), (6, "the dog" * 9000, None), (7, "é", "")]
    docs = spark.createDataFrame([(*r, True, 1, 1) for r in data], schema)
    got = [(r["doc_id"], r["lang_pred"]) for r in identify_languages(docs).collect()]
    assert len(got) == len(data) and (None, "und") in got and (1, "und") in got and (2, "und") in got and (5, "und") in got
    assert (6, "en") in got and got.count((3, "en")) == 2
    assert identify_languages(docs.limit(0)).count() == 0
    nothing = identify_languages(docs.withColumn("lang", docs["lang"].substr(1, 0)).filter("doc_id IS NULL"))
    assert [(r["lang_pred"], r["score"]) for r in nothing.collect()] == [("und", 0.0)]


def test_the_model_keeps_its_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs, max_grams=500)
    assert len(model[1]) == 500
    rows = docs.selectExpr("doc_id", "text", "lang", "false AS held_out")
    got = predict(rows, model, "small").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.8


def test_a_small_language_beside_many_grams(spark):
    rng = np.random.default_rng(6)
    junk = "".join(map(chr, rng.integers(48, 123, 520_000)))
    large = [(4 * i, junk[i % 20 * 26_000 :][:26_000], "large") for i in range(40)]
    small = [(i, "é漢ñ字 ß語ö文", "small") for i in range(20_001, 20_002)]
    docs = spark.createDataFrame(large + small, "doc_id bigint, text string, lang string")
    langs, grams, counts = train(docs)
    assert langs == ["large", "small"] and len(grams) > 400_000 and (counts[:, 1] > 0).sum() > 15
    assert {r["lang_pred"] for r in predict(docs.selectExpr("doc_id", "text", "false AS held_out"), (langs, grams, counts), "all").filter("doc_id > 20000").collect()} == {"small"}
