"""Prefix token counts, packing, fingerprints and mixing against plain definitions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagerisk.llm.fingerprints import added, edited_fingerprints, fingerprints, lanes_of, likeness, paragraphs, removed, state, text_form
from pagerisk.llm.mixing import mix, source_targets
from pagerisk.llm.packing import Encoder, pack, pack_documents, step_groups
from pagerisk.llm.tokens import PrefixCounter, token_counts

SF = "/root/testdata/sf0.001"
ODD = ["a", "B", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", "　", "é", "é", "\U0001f600", "½", "Ⅷ", "Σ", "'s", "'re", "'", "don't",
       "<|endoftext|>", "<|startoftext|>", "<|", "漢字", "​", "\x00", "12", "__", "--", "İ", "ﬁ"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, start bigint, target string, part int"


def odd_texts(n, longest=14, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def rows(texts, ids=None):
    """Documents with columns whose names clash with those the operators make."""
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", f"s{(i or 0) % 3}", 0, 7, "x", 9) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def tricky(spark):
    values = [None, "", "one", "one", "same text\nagain", "same text\nagain", "x" * 60_000, "ab " * 20_000, *odd_texts(40)]
    ids = [None, 5, 5, 7, 7, *range(8, 8 + len(values) - 5)]
    return spark.createDataFrame(rows(values, ids), DOCS)


def test_counts_equal_the_library(texts):
    own, library = PrefixCounter(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    every = texts + odd_texts(3000)
    assert [own.count(t) for t in every] == [len(e.ids) for e in library.encode_batch(every, add_special_tokens=False)]


def test_every_prefix_of_a_text():
    own, library = PrefixCounter(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in odd_texts(150) + ["The quick brown fox  jumped; it's 12:30."]:
        table = own.table(text)
        assert [own.count_prefix(text, table, i) for i in range(len(text) + 1)] == [n(text[:i]) for i in range(len(text) + 1)]
        for budget in range(5):
            fits = own.fitting(table, budget)
            assert n(text.encode()[:fits].decode()) <= budget
            assert fits in table[0] and all(c > budget for e, c in zip(*table, strict=True) if e > fits)
    for word in ("unbelievable", "aaaaaaaaa", " naïveté"):
        raw = word.encode()
        whole = [i for i in range(len(raw) + 1) if raw[:i].decode(errors="ignore").encode() == raw[:i]]
        assert [own.prefixes(raw)[i] for i in whole] == [n(raw[:i].decode()) for i in whole]


def test_token_counts_on_hard_rows(spark, tricky):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts(tricky, 1024, table=True).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in tricky.collect()]
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got] == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) and r["prefix_tokens"][-1] == r["n_tokens"] and r["prefix_bytes"][-1] == r["n_bytes"] for r in got)
    assert token_counts(tricky.limit(0)).count() == 0


def test_encoder_equals_the_library(texts):
    own, library = Encoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    every = texts[:80] + odd_texts(3000)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(every, add_special_tokens=False)]
    assert own.encode(every) == want


def test_plain_words_share_their_letters_and_marks():
    own, library = Encoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.encode(["Word word, WORD.", "wORD"])
    assert own.known.keys() == {"", "word", ",", "."}
    letters = [chr(c) for c in range(65, 256) if chr(c).isalpha()] + ["Élan", "STRASSE", "straße", "µm", "ªº", "dont"]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()] + ["", "...", "'s", "'", "$$$", "<|endoftext|>", "́", ".'", "≠"]
    texts = [a + m + a for a in letters for m in marks] + [" ".join(a + m for a in letters for m in marks)]
    assert own.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode([]) == []


@pytest.mark.parametrize("seed", range(6))
def test_pack_covers_every_token_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 255, 256, 257, 2048, 4096, rng.randint(1, 300), rng.randint(1, 9000)]) for _ in range(rng.choice([0, 1, 5, 400]))]
    packed = pack(lengths)
    covered = sorted((item, at + k) for row in packed for item, at, n in row for k in (0, n - 1))
    pieces = sorted((item, at, n) for row in packed for item, at, n in row)
    for item, length in enumerate(lengths):
        own = [(at, n) for i, at, n in pieces if i == item]
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == length
    sizes = [sum(n for _, _, n in row) for row in packed]
    assert covered is not None and max(sizes, default=0) <= 2048
    assert sum(2048 - s for s in sizes if s & (s - 1)) < 2048
    loads = np.bincount(step_groups(sizes), weights=sizes) if sizes else [0]
    assert max(loads) - min(loads) <= 2048


def test_packed_pieces(spark, tricky):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = pack_documents(tricky, block_bytes=50_000).collect()
    whole = {}
    for r in tricky.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        whole.setdefault((r["doc_id"], len(ids)), []).append(np.array(ids, "<u4"))
    for r in got:
        part = slice(r["start"], r["start"] + r["length"])
        assert r["ids_crc32"] in {zlib.crc32(ids[part].tobytes()) for ids in whole[r["doc_id"], r["doc_tokens"]]}
    assert sum(r["length"] for r in got) == sum(len(ids) for group in whole.values() for ids in group)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    for pieces in by_sequence.values():
        pieces.sort()
        assert [p[0] for p in pieces] == [sum(p[1] for p in pieces[:i]) for i in range(len(pieces))]
        total = sum(p[1] for p in pieces)
        assert total <= 2048 and {p[2] for p in pieces} == {total if total & (total - 1) == 0 else 2048}
    assert pack_documents(tricky.limit(0)).count() == 0


def test_fingerprint_algebra():
    a, b = paragraphs("x\n\nsecond line\nx"), paragraphs("another paragraph\nof text")
    assert np.array_equal(state(a), state(a[::-1])) and not np.array_equal(state(a), state(a[1:]))
    assert np.array_equal(added(state(a), b), state(a + b)) and np.array_equal(removed(state(a + b), b), state(a))
    assert len({state(paragraphs(t)).tobytes() for t in ("", "\n", "\n\n", "a", "a\0", "a\0\0", " a")}) == 7
    assert likeness(state(a), state(a)) == 1.0 and likeness(state(a), state([])) == 0.0


def test_edited_fingerprints(spark, tricky):
    got = edited_fingerprints(tricky.union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text", "lang", "source", "n_chars", "1L", "'t'", "2"))).collect()
    source = tricky.select("doc_id", "text").collect() + [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    order = sorted(source, key=lambda r: (-r[0] if r[0] is not None else 1 << 60, r[1] is not None, (r[1] or "").encode()))
    want = []
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), state(paragraphs(text)).tobytes(), state(paragraphs(edited)).tobytes()))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], lanes_of(r["fingerprint"]).tobytes(), lanes_of(r["edited_fingerprint"]).tobytes()) for r in got], key=key) == sorted(want, key=key)
    long = [r for r in got if r["n_chars"] > 400]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert np.mean([r["near_edited"] for r in long]) > 0.3 > 0.15 > np.mean([r["near_next"] for r in long])
    plain = {(r["doc_id"], r["fingerprint"]) for r in fingerprints(tricky).collect()}
    assert plain == {(r["doc_id"], r["fingerprint"]) for r in got if r["doc_id"] is None or r["doc_id"] < 1000}


def test_edited_fingerprints_of_few_rows(spark):
    one = spark.createDataFrame(rows(["abcdef"]), DOCS)
    r = edited_fingerprints(one).collect()
    assert [x["edited_sha256"] for x in r] == [hashlib.sha256(b"abcabc").hexdigest()]
    assert edited_fingerprints(one.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a" * 40_000, "0 " * 50_000, "a" * 300_000])
def test_likeness_of_long_repetitive_texts(text):
    """Counts beyond 16 bits keep their sign: an edit of such a text stays near to it, its half too."""
    whole, half, other = (state(paragraphs(t)) for t in (text, text[: len(text) // 2], "quite another text, not like it"))
    assert likeness(whole, half) > 0.999 and likeness(whole, other) < 0.5
    assert np.array_equal(lanes_of(text_form(whole)), whole)


def water(sizes, weights, share=1.5, most=2.0):
    """Share out by weight, again and again, until no source is above its cap."""
    left, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


def test_targets_are_the_fixed_point(spark):
    rng = random.Random(5)
    for n in (1, 2, 7, 40):
        sizes = [rng.choice([0, rng.randint(1, 50), rng.randint(1, 100_000)]) for _ in range(n)]
        names = [f"s{i:03}" for i in range(n - 1)] + [None]
        got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size bigint")).collect()}
        want = water(sizes, [(3, 1, 2)[i % 3] for i in range(n)])
        assert [got[k] for k in names] == pytest.approx(want)


def test_mix_on_hard_rows(spark, tricky):
    more = tricky.union(spark.createDataFrame([(100 + i, "w " * (i % 40), "en", None, 0, 7, "x", 9) for i in range(300)], DOCS))
    quality = spark.createDataFrame([(100, 2.0), (100, 1.0), (101, None), (102, -1.0)], "doc_id bigint, weight double")
    got = mix(more, quality=quality).collect()
    assert len(got) == more.count() and all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2 for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        short = own[0]["target"] - sum(r["taken"] for r in own)
        untaken = [r["size"] for r in own if r["size"] and r["copies"] == int(own[0]["target"] // own[0]["source_size"])]
        assert short > -1e-6 and (not untaken or short < min(untaken))
    assert sorted(map(str, got)) == sorted(map(str, mix(more.repartition(7), quality=quality).collect()))
    assert mix(tricky.limit(0)).count() == 0


@pytest.mark.parametrize("case", ["one long document", "repeated rows", "falling sizes"])
def test_mix_goes_past_documents_that_do_not_fit(spark, case):
    """Taken words come within 1 % of the target and never above it, also with one very long document or one id for all rows."""
    texts = {
        "one long document": [(i, "w " * 100) for i in range(2000)] + [(5000, "x " * 100_000)],
        "repeated rows": [(7, "w " * 1000)] * 100 + [(8, "x " * 20_000)],
        "falling sizes": [(i, "w " * (1500 - i)) for i in range(1500)],
    }[case]
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts] + [(100_000 + i, "y " * 10, None) for i in range(500)], "doc_id bigint, text string, source string").repartition(3)
    for seed in ("mix", "other", "third"):
        got = mix(docs, seed=seed).collect()
        for source in ("s", None):
            own = [r for r in got if r["source"] == source]
            taken, target = sum(r["taken"] for r in own), own[0]["target"]
            assert 0.99 * target <= taken <= target and max(r["copies"] for r in own) <= 2
