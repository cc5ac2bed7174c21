"""Archives, neighbours, quality and the pipeline."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from pagerisk.llm import warc
from pagerisk.llm.language import identify_languages
from pagerisk.llm.mixing import label_weights, mix
from pagerisk.llm.neighbours import hilbert_keys, nearest
from pagerisk.llm.quality import score_quality
from pagerisk.session import work_dir

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, payload int, refers_to string, digest string, revisit int"


def page_rows():
    same, empty = "<p>same é</p>" * 30, ""
    values = [(1, "http://a/", same), (2, "http://b/ x\r\nEvil: 1", same), (9, None, same), (9, None, same), (3, "u", None), (4, "u", empty), (None, "u", same), (None, "u", "alone"), (-5, "u", "x" * 200_000)]
    return values + [(100 + i, f"http://h/{i}", f"<html><body>page {i} {'lorem ipsum ' * (i % 9)}</body></html>") for i in range(300)]


@pytest.mark.parametrize("min_bytes", [0, 100])
def test_archives(spark, min_bytes):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, 1, "2", "3", 4) for r in rows], PAGES)
    folder = work_dir(spark, "warc-test")
    archives = warc.write_archives(pages, folder, min_bytes, archive_bytes=20_000)
    got = warc.read_archives(archives, payloads=True).collect()
    assert archives.count() > 5 and sum(r["records"] for r in archives.collect()) == len(rows) == len(got)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    largest = {}
    for i, p in payloads:
        if len(p) >= min_bytes and i is not None:
            largest[p] = max(largest.get(p, i), i)
    want = []
    for i, p in payloads:
        first = largest.get(p)
        revisit = len(p) >= min_bytes and first is not None and i != first and sum(q == p for _, q in payloads) > 1
        want.append((i, len(p), digest(p), "revisit" if revisit else "response", first if revisit else None, None if revisit else p))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["record_type"] == "revisit" else bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archive_bytes_follow_the_format():
    records = [warc.record(i, f"http://h/{i}", f"<p>text {i % 7} of a page</p>".encode() * 20, None, False, "2000-01-01T00:00:00Z") for i in range(200)]
    data = warc.archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.read_archive(data)) == records
    size = int.from_bytes(data[4:8], "little")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert unpacker.decompress(data[8 + size : warc.frame_end(memoryview(data), 8 + size)]) == records[0]
    assert list(warc.read_archive(warc.archive(records[:2]))) == records[:2] and list(warc.read_archive(b"")) == []
    for i in (None, 0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(i)) == i
    with pytest.raises(ValueError):
        warc.parse(records[0].replace(b"text", b"tEXt"))


@pytest.mark.parametrize("count,size", [(1, 300), (3, 5_000), (40, 900_000), (5, 4_000_000)])
def test_every_archive_begins_with_its_dictionary(count, size):
    rng = random.Random(count)
    words = [f"word{i}" for i in range(3000)]
    page = " ".join(rng.choice(words) for _ in range(size // 7))
    records = [warc.record(i, f"http://a.b/{i}", f"<p>{i} {page[i:]}</p>".encode(), None, False, "2024-01-01T00:00:00Z") for i in range(count)]
    data = warc.archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(data[4:8], "little") > 8
    assert list(warc.read_archive(data)) == records


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = np.argsort(hilbert_keys(grid, bits))
        assert sorted(hilbert_keys(grid, bits).tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def plain_nearest(rows, k, every):
    known = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, v in known:
        if q % every == 0:
            scored = sorted((-float(np.dot(np.array(v), np.array(w))), i) for i, w in known if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_with_hard_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [rows[5], (None, rows[1][1]), (2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("inf")] * 8), (2080, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id bigint, embedding array<double>, rep int, query int, window int")
    want = plain_nearest(rows, 20, 20)
    got = {}
    for r in nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(want)
    for q, found in got.items():
        assert [i for i, _, _ in found] == [i for i, _ in want[q]] and [r for *_, r in found] == list(range(1, len(found) + 1))
        assert [s for _, s, _ in found] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    assert nearest(table.limit(0)).count() == 0
    assert nearest(table.filter("vec_id = 20")).count() == 0


def test_recall_in_small_windows(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    found = {}
    for r in nearest(vectors, window=600).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q, near in found.items():
        scores = np.where(ids == q, -9, x @ x[ids == q][0])
        hits.append(len(near & set(ids[np.argsort(-scores)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_recall_where_windows_hold_little_of_the_table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    curves, window = 2, 50
    random_share = 1 - (1 - 3 * window / 3150) ** curves  # what random orders would meet in three windows per curve
    assert random_share < 0.1
    found = {}
    for r in nearest(table, curves=curves, window=window).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x @ x.T
    np.fill_diagonal(scores, -9)
    assert len(found) == 150
    assert np.mean([len(near & set(np.argsort(-scores[q])[:20].tolist())) / 20 for q, near in found.items()]) >= 0.9


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = {r["doc_id"]: r for r in score_quality(docs, labels, rounds=2).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored.values())
    held = spark.sql("SELECT id AS doc_id FROM range(1000) WHERE pmod(xxhash64(id), 5) = 4").collect()
    good, bad = ([scored[r["doc_id"]]["score"] for r in held if truth.get(r["doc_id"]) == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.85  # held-out ranking of good before poor


def test_quality_of_hard_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, y double, tokens string, score string"
    data = [(None, None, None, None), (1, "", "en", "a"), (2, "good words here", None, "a"), (2, "good words here", None, "a"), (3, "z" * 50_000, "en", None), *[(10 + i, "good text" if i % 2 else "%%% junk %%%", "en", "b") for i in range(60)]]
    docs = spark.createDataFrame([(*r, 0.0, "t", "s") for r in data], schema)
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(60)] + [(10, None), (11, 7), (None, 1)], "doc_id bigint, quality int")
    got = score_quality(docs, labels, rounds=1).collect()
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[11] > by_id[10]
    assert {r["score"] for r in score_quality(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_stages(spark, tmp_path):
    """Each stage on what the one before it kept, against a plain version of its decision."""
    from test_jaccard import plain_groups
    from test_substrings import brute

    raw = spark.read.parquet(f"{SF}/documents.parquet")
    clash = spark.createDataFrame([(9001, None, None, "src1", 0), (9002, "", "en", None, 0), (9003, "123 456", "en", "src1", 7), (None, "Some text without an id, but long enough to say something about its language.", None, "src2", 9)], raw.schema)
    docs, stages = raw.union(clash), dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_strings", "mixture", "packing"]
    tuples = lambda frame: sorted((tuple(r) for r in frame.collect()), key=str)

    named = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    first = spark.createDataFrame(tuples(stages["language"](spark, docs, SF)), raw.schema)
    want = [(r["doc_id"], r["text"], r["lang"] or named[r["doc_id"]]["lang_pred"], r["source"], r["n_chars"]) for r in docs.collect() if named[r["doc_id"]]["lang_pred"] != "und" and named[r["doc_id"]]["score"] >= 0.5]
    assert tuples(first) == sorted(want, key=str) and len(want) > 150

    second = spark.createDataFrame(tuples(stages["near_duplicates"](spark, first, SF)), raw.schema)
    groups = {i: c for i, _, c in plain_groups([(r["doc_id"], r["text"]) for r in first.collect()], 5, 80)}
    assert tuples(second) == sorted((tuple(r) for r in first.collect() if groups[r["doc_id"]] == r["doc_id"]), key=str)
    assert second.count() < first.count()

    third = spark.createDataFrame(tuples(stages["repeated_strings"](spark, second, SF)), raw.schema)
    cut = {i: (gone, n) for i, n, gone, _, _ in brute([(r["doc_id"], r["text"]) for r in second.collect()])}
    kept = {r["doc_id"]: r for r in third.collect()}
    assert set(kept) == {i for i, (gone, n) in cut.items() if gone < n or not gone}
    assert all(len(kept[i]["text"].encode()) in range(cut[i][1] - cut[i][0] - 8, cut[i][1] - cut[i][0] + 1) and kept[i]["n_chars"] == len(kept[i]["text"]) for i in kept)

    fourth = spark.createDataFrame(tuples(stages["mixture"](spark, third, SF)), raw.schema)
    copies = {r["doc_id"]: r["copies"] for r in mix(third, quality=label_weights(spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert tuples(fourth) == sorted((tuple(r) for r in third.collect() for _ in range(copies[r["doc_id"]])), key=str)

    packed = stages["packing"](spark, fourth, SF).collect()
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    assert sum(r["start"] == 0 for r in packed) == fourth.count()
    for stage in stages.values():
        stage(spark, docs.limit(0), SF).count()


def test_the_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "other"), (None, "a b"), (None, "a b"), (None, None), (None, ""), (2, "a b")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 3) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = sorted(((r.doc_id, r.text or "", r.source) for r in corpus_pipeline.one_of_repeats(docs).collect()), key=str)
    assert [g[:2] for g in got] == sorted([(1, "a b"), (1, "other"), (2, "a b"), (None, ""), (None, "a b")], key=str)
    assert corpus_pipeline.one_of_repeats(docs.limit(0)).count() == 0
