"""Suffix arrays and the removal of repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from pagerisk.llm import common, substrings
from pagerisk.llm.substrings import LENGTH, remove_repeats, repeats_in_range, window_hashes
from pagerisk.llm.suffixes import _order, common_prefixes, suffix_array, suffix_groups

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, kind string, row string"


def strings(seed):
    rng = random.Random(seed)
    return [b"", b"a", b"a" * 300, b"ab" * 150, bytes(rng.choice(b"ab") for _ in range(500)), bytes(rng.choice(b"\0\xff") for _ in range(400)), bytes(range(256)) * 2]


@pytest.mark.parametrize("depth", [5, 50, 64])
def test_suffix_array_and_common_prefixes(depth):
    for text in strings(1):
        data = np.frombuffer(text, np.uint8)
        array, rank = suffix_array(data, depth)
        prefixes = [text[i : i + depth] for i in array]
        assert sorted(array.tolist()) == list(range(len(text))) and prefixes == sorted(prefixes)
        common = common_prefixes(data, array, rank, depth, lanes=7)
        for place in range(1, len(text)):
            a, b = text[array[place - 1] :], text[array[place] :]
            n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[place] == min(n, depth)


@pytest.mark.parametrize("depth", [4, 7, 8, 50])
def test_suffix_groups_are_those_of_the_depth(depth):
    for text in [*strings(4), b"abcdefgh" * 9 + b"abcdefghabcdefgx" * 5]:
        array, group = suffix_groups(np.frombuffer(text, np.uint8), depth)
        prefixes = [text[i : i + depth] for i in range(len(text))]
        assert [prefixes[i] for i in array] == sorted(prefixes)
        assert len(set(zip(prefixes, group.tolist(), strict=True))) == len(set(prefixes)) == len(set(group.tolist()))


@pytest.mark.parametrize("alike", [False, True])
def test_repeats_of_strings(monkeypatch, alike):
    """Also where all hashes are the same."""
    if alike:
        monkeypatch.setattr(substrings, "window_hashes", lambda data, step=1, places=None: np.zeros(len(places), np.uint64))
    rng = random.Random(7)
    base = "".join(rng.choice("abc") for _ in range(120)).encode()
    texts = [base[at : at + rng.randint(50, 84)] for at in [rng.randint(0, 30) for _ in range(25)]] + [b"a" * 60, b"a" * 51, b"q" * 84]
    texts += texts[:9]
    docs = np.array([rng.randint(0, 9) for _ in texts])
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    whole, string, step = substrings.repeats_of_strings(data, sizes, docs)
    got = {(k, at) for k in np.flatnonzero(whole) for at in range(sizes[k] - LENGTH + 1)} | set(zip(string.tolist(), step.tolist(), strict=True))
    windows = [(k, at, t[at : at + LENGTH]) for k, t in enumerate(texts) for at in range(len(t) - LENGTH + 1)]
    assert got == {(k, at) for k, at, w in windows if any(v == w and docs[j] < docs[k] for j, _, v in windows)}


def test_finished_tables_leave_the_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "work_dir", lambda spark, name: f"{tmp_path}/{name}")
    docs = spark.createDataFrame([(*r, "en", "s", 0, 1, "k", "r") for r in hard_rows(8)], DOCS)
    assert remove_repeats(docs).filter("n_removed > 0").count()
    assert {p.relative_to(tmp_path).parts[0] for p in tmp_path.rglob("*.parquet")} == {"repeated-spans"}


def test_wide_keys_sort_alike():
    rng = np.random.default_rng(2)
    major, minor = rng.integers(0, 50, 1000), rng.integers(0, 50, 1000)
    assert np.array_equal(_order(major, minor, 6), _order(major, minor, 40))


def test_equal_hashes_are_told_apart(monkeypatch):
    data = np.frombuffer(b"x" * LENGTH + b"y" * LENGTH + b"y" * LENGTH, np.uint8)
    same = lambda n: np.zeros(n, np.uint64)
    at = np.array([0, LENGTH, 2 * LENGTH])
    got = repeats_in_range([(same(2), np.array([1, 5]), at[:2]), (same(1), np.array([7]), at[2:])], data)
    assert [g.tolist() for g in got] == [[False, False], [True]]
    assert len(np.unique(window_hashes(data)[at])) == 2


def brute(rows):
    """By definition: the smallest document of every string, then the union of covered bytes."""
    first = {}
    texts = [(doc_id if doc_id is not None else 1 << 62, doc_id, (text or "").encode()) for doc_id, text in rows]
    for order, _, raw in texts:
        for i in range(len(raw) - LENGTH + 1):
            window = raw[i : i + LENGTH]
            first[window] = min(first.get(window, order), order)
    out = []
    for order, doc_id, raw in texts:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - LENGTH + 1):
            if first[raw[i : i + LENGTH]] < order:
                gone[i : i + LENGTH] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def hard_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ漢") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(14) for _ in range(4)] + ["x" * 70, "ab" * 60, "é" * 25, "y" * 50, "z" * 49]
    rows = [(None, None), (1, ""), (2, None), (None, passages[0])]
    for i in range(60):
        parts = [rng.choice([prose(rng.randint(0, 20)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 9):]]) for _ in range(rng.randint(0, 5))]
        rows.append((rng.randint(3, 50), rng.choice(["", " "]).join(parts)))
    rows += [rows[10], rows[10], (99, rows[10][1]), (100, passages[0] * 40), (101, passages[0] * 40), (0, "a" * 3000), (102, "a" * 2000)]
    return rows


@pytest.mark.parametrize("seed,piece,parts", [(1, 1 << 20, 4), (2, 600, 3), (3, 5000, 1)])
def test_removal(spark, monkeypatch, seed, piece, parts):
    rows = hard_rows(seed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    monkeypatch.setattr(substrings, "PIECE", piece)
    try:
        docs = spark.createDataFrame([(*r, "en", "s", 0, 1, "k", "r") for r in rows], DOCS)
        got = remove_repeats(docs, keep="bytes").collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == brute(rows)
        assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
        texts = [tuple(r) for r in remove_repeats(docs, keep="text", carry=("lang", "n_chars")).select("doc_id", "kept", "lang", "n_chars").collect()]
        assert sorted(texts, key=str) == sorted(((r["doc_id"], r["kept"].decode(errors="ignore"), "en", 0) for r in got), key=str)
        assert remove_repeats(docs.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_removal_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in remove_repeats(docs).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()])
    assert any(r[2] for r in got)


def test_windows_of_equal_hash_are_told_apart():
    windows = np.frombuffer(b"x" * LENGTH + b"y" * LENGTH + b"x" * LENGTH + b"\0" * LENGTH, f"S{LENGTH}")
    assert substrings.repeated_windows(np.zeros(4, np.uint64), windows, np.array([3, 5, 4, 9])).tolist() == [False, False, True, False]


@pytest.mark.parametrize("seed", [5, 6])
def test_a_common_phrase_in_different_text(spark, monkeypatch, seed):
    """No task gets all the strings around one anchor."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    phrase = "Licensed under some public license"
    rows = [(i, noise(60) + phrase + noise(60)) for i in range(600)]
    rows += [(1000 + i, noise(5) + rows[7 * i][1][rng.randint(0, 50):]) for i in range(60)] + hard_rows(seed)
    most, whole = 20_000, substrings.repeats_in_range

    def bounded(lists, data):
        assert len(data) < most, len(data)
        return whole(lists, data)

    monkeypatch.setattr(substrings, "HOT", 50)
    monkeypatch.setattr(substrings, "repeats_in_range", bounded)
    docs = spark.createDataFrame([(*r, "en", "s", 0, 1, "k", "r") for r in rows], DOCS)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs).collect()), key=str)
    assert got == brute(rows)


def test_rows_that_are_sent_do_not_grow_with_the_pieces(spark, monkeypatch):
    """Between shards and ranges goes one row, however many pieces and hot anchors a shard has."""
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdefghij klmnop") for _ in range(200)) for _ in range(40)]
    rows = [(i, "".join(rng.choice("abcdefghij klmnop") for _ in range(30)).join(rng.sample(passages, 6))) for i in range(120)]
    parts, found, whole = int(spark.conf.get("spark.sql.shuffle.partitions")), {}, substrings.settle

    def counted(df, name, *kinds):
        out = whole(df, name, *kinds)
        if kinds:
            found.update({r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()})
        return out

    monkeypatch.setattr(substrings, "PIECE", 600)
    monkeypatch.setattr(substrings, "_TEXT_BYTES", 2000)
    monkeypatch.setattr(substrings, "settle", counted)
    docs = spark.createDataFrame([(*r, "en", "s", 0, 1, "k", "r") for r in rows], DOCS)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs).collect()), key=str)
    assert got == brute(rows)
    assert found[-1] > parts and found[0] <= parts * parts and found[-2] <= parts


def test_batches_are_filled():
    schema = substrings.pa.schema([("shard", substrings.pa.int32()), ("blob", substrings.pa.binary())])
    batches = list(substrings._batched(((i, b"x" * 100) for i in range(1000)), schema))
    assert [b.num_rows for b in batches] == [1000]
    assert list(substrings._batched(iter([]), schema)) == []


def test_a_hot_anchor_without_repeats(spark, monkeypatch):
    """Ranges in which nothing repeats report nothing."""
    rng = random.Random(9)
    noise = lambda: "".join(rng.choice("abcdefghij klmnop") for _ in range(60))
    rows = [(i, noise() + "Licensed under some public license" + noise()) for i in range(200)]
    monkeypatch.setattr(substrings, "HOT", 50)
    docs = spark.createDataFrame([(*r, "en", "s", 0, 1, "k", "r") for r in rows], DOCS)
    assert [r["n_removed"] for r in remove_repeats(docs).collect()] == [0] * 200
