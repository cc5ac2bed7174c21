"""Language identification by prediction by partial matching.

Each language owns a tree of byte contexts of up to three bytes with symbol
counts. A byte costs -log2 of its share in the longest context that has been
seen; where the context lacks the byte, the cost of an escape is added and the
next shorter context decides, down to a uniform byte. Statistics are frozen
after training, so the code length of a text is a plain sum, the same wherever
it is computed; costs are kept as integers of 1/4096 bit. The language with the
shortest code wins.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerisk.llm.common import slices, utf8

#: Integer cost units per bit.
UNIT = 4096
#: Bytes of context, and of a counted gram: the context and its symbol.
ORDER = 3
_TEXT_BYTES = 2 << 20


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind ORDER zero bytes each, and the place of each text's first zero."""
    at = offsets + ORDER * np.arange(len(offsets))
    out = np.zeros(int(at[-1]), np.uint8)
    n = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(n) + 1), n)] = data
    return out, at


def _grams(padded: np.ndarray) -> np.ndarray:
    """The four bytes that end at each position from ORDER on, as one integer."""
    b = padded.astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """Counts of all four-byte grams per language: lang, gram, n. One row per task, language and gram is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, "text", _TEXT_BYTES):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                data, offsets = utf8(batch.column("text").filter(pa.array(langs == lang)))
                padded, at = _padded(data, offsets)
                if len(padded) <= ORDER:
                    continue
                grams = _grams(padded)
                # Windows that begin before a text's zeros reach into the text before.
                real = np.ones(len(grams), bool)
                for back in range(1, ORDER + 1):
                    border = at[1:-1] - back
                    real[border[border >= 0]] = False
                grams, n = np.unique(grams[real], return_counts=True)
                if lang in known:
                    old, old_n = known[lang]
                    grams, inverse = np.unique(np.concatenate([old, grams]), return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([old_n, n])).astype(np.int64)
                known[lang] = grams, n
        for lang, (grams, n) in known.items():
            for lo in range(0, len(grams), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(grams[part]), pa.string()), "gram": pa.array(grams[part].astype(np.int64)), "n": pa.array(n[part].astype(np.int64)),
                })

    used = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return used.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """The frozen context trees of all languages, and the code lengths they give."""

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray):
        """``grams`` ascending and distinct, ``counts`` of shape (grams, languages)."""
        self.langs = langs
        width = len(langs)
        levels = {4: (grams.astype(np.int64), counts)}
        for k in (3, 2, 1):
            keys, inverse = np.unique(levels[k + 1][0] & ((1 << 8 * k) - 1), return_inverse=True)
            levels[k] = keys, np.stack([np.bincount(inverse, n, len(keys)) for n in levels[k + 1][1].T], axis=1)
        cost, escape = {0: np.full((1, width), 8.0)}, {}
        for k in (1, 2, 3, 4):
            keys, counted = levels[k]
            contexts, inverse = np.unique(keys >> 8, return_inverse=True)
            lower = np.searchsorted(levels[k - 1][0], keys & ((1 << 8 * (k - 1)) - 1)) if k > 1 else np.zeros(len(keys), np.int64)
            cost[k], leave = np.empty(counted.shape, np.int32 if k == 4 else np.float64), np.zeros((len(contexts), width))
            for lang in range(width):  # one language at a time: few whole columns in memory
                n = counted[:, lang].astype(np.float64)
                total, kinds = np.bincount(inverse, n, len(contexts)), np.bincount(inverse, n > 0, len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    leave[:, lang] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                    seen = -np.log2(n / (total + kinds)[inverse])
                bits = np.where(n > 0, seen, leave[inverse, lang] + cost[k - 1][lower, lang])
                cost[k][:, lang] = np.round(bits * UNIT) if k == 4 else bits
            escape[k] = contexts, leave
        units = lambda x: np.round(x * UNIT).astype(np.int32)
        first = units(np.zeros((1, width)))

        # Dense tables for the two short orders, tries for the others; row 0 of a trie level means "never seen".
        one = np.tile(escape[1][1] + cost[0], (256, 1)) if len(escape[1][0]) else np.tile(cost[0], (256, 1))
        one[levels[1][0]] = cost[1]
        two = np.tile(one, (256, 1))
        leave1 = np.zeros((256, width))
        leave1[escape[2][0]] = escape[2][1]
        two += np.repeat(leave1, 256, axis=0)
        two[levels[2][0]] = cost[2]
        leave2 = np.zeros((1 << 16, width))
        leave2[escape[3][0]] = escape[3][1]
        leave3 = np.zeros((len(levels[3][0]) + 1, width))
        row3 = np.searchsorted(levels[3][0], escape[4][0])
        there = (row3 < len(levels[3][0])) & (np.append(levels[3][0], -1)[row3] == escape[4][0])
        leave3[row3[there] + 1] = escape[4][1][there]
        self.two, self.leave2, self.leave3 = units(two), units(leave2), units(leave3)
        self.three, self.four = np.vstack([first, units(cost[3])]), np.vstack([first, cost[4]])

        pairs = np.unique(levels[3][0] >> 8)
        self.row2 = np.zeros(1 << 16, np.int32)
        self.row2[pairs] = np.arange(1, len(pairs) + 1)
        self.next3 = np.zeros((len(pairs) + 1) * 256, np.int32)
        self.next3[self.row2[levels[3][0] >> 8].astype(np.int64) * 256 + (levels[3][0] & 255)] = np.arange(1, len(levels[3][0]) + 1)
        # A context of three bytes need not be a gram of three bytes that ends anywhere: only those in the trie have children.
        head = np.searchsorted(levels[3][0], levels[4][0] >> 8)
        known = (head < len(levels[3][0])) & (np.append(levels[3][0], -1)[head] == levels[4][0] >> 8)
        # The grams below a row of three bytes, as 8 words of 32 bits with the place of each word's first gram: grams are in order.
        self.word4, self.base4 = np.zeros((len(levels[3][0]) + 1) * 8, np.uint32), np.zeros((len(levels[3][0]) + 1) * 8, np.int32)
        symbol = levels[4][0][known] & 255
        slot = (head[known] + 1) * 8 + (symbol >> 5)
        np.bitwise_or.at(self.word4, slot, np.uint32(1) << (symbol & 31).astype(np.uint32))
        slots, begin = np.unique(slot, return_index=True)
        self.base4[slots] = np.flatnonzero(known)[begin] + 1

    def _four(self, three: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Row of the gram of four bytes that goes on from a row of three, 0 if never seen."""
        slot = three.astype(np.int64) * 8 + (symbols >> 5)
        word, bit = self.word4[slot], np.uint32(1) << (symbols & 31).astype(np.uint32)
        return np.where(word & bit, self.base4[slot] + np.bitwise_count(word & (bit - np.uint32(1))), 0)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every text under every language, in units: (texts, languages)."""
        out = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        if not len(data):
            return out
        padded, at = _padded(data, offsets)
        b = padded.astype(np.int32)
        pair = (b[:-1] << 8) | b[1:]  # ends at i + 1
        three = self.next3[self.row2[pair[:-1]] * 256 + b[2:]]  # ends at i + 2
        four = self._four(three[:-1], b[3:])  # ends at i + 3
        cost = self.four[four]
        missed = np.flatnonzero(four == 0)
        if len(missed):
            tail = three[missed + 1]
            lower = np.where((tail > 0)[:, None], self.three[tail], self.leave2[pair[missed + 1]] + self.two[pair[missed + 2]])
            cost[missed] = self.leave3[three[missed]] + lower
        # Texts begin at at[i] + ORDER; cost[j] belongs to the byte at j + ORDER.
        sums = np.zeros((len(cost) + 1, len(self.langs)), np.int64)
        np.cumsum(cost, axis=0, dtype=np.int64, out=sums[1:])
        return sums[np.maximum(at[1:] - ORDER, at[:-1])] - sums[at[:-1]]


@functools.lru_cache(maxsize=2)
def _trees(held) -> Trees:
    return Trees(*held.value)


class _Held:
    """A broadcast model, equal to itself by its id, so that a worker builds its trees once."""

    def __init__(self, broadcast, key: str):
        self.broadcast, self.key = broadcast, key

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


def train(docs: DataFrame, max_grams: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, grams and counts of the frozen trees.

    Counts cover all given rows with text and language, and all their grams are
    kept: what is broadcast grows with the distinct grams times the languages.
    ``max_grams`` keeps the most frequent (ties: smaller gram) of all languages
    together instead.
    """
    from pagerisk.llm.common import settle

    counted = settle(gram_counts(docs), "grams")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros(0, np.int64), np.zeros((0, 0))
    if max_grams is not None:
        top = counted.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(max_grams).select("gram")
        counted = counted.join(top, "gram")
    kept = counted.groupBy("gram").agg(
        *[F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    ).toArrow()
    grams = kept.column("gram").to_numpy()
    counts = np.stack([kept.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1)
    counts = counts if counts.max(initial=0) >> 31 else counts.astype(np.int32)
    order = np.argsort(grams)
    return langs, grams[order].astype(np.int64), counts[order]


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], name: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score of every text: doc_id, held_out, lang_pred, score, and the columns named in ``carry`` as they are.

    ``score`` is the winner's share of the likelihoods of all languages. Texts
    that are NULL or have no letter, and all texts if nothing was learned, are
    ``und`` with score 0. Ties go to the first language in code point order.
    """
    import uuid

    held = _Held(docs.sparkSession.sparkContext.broadcast(model), f"{name}-{uuid.uuid4().hex}")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(held) if held.value[0] else None
        for batch in slices(batches, "text", _TEXT_BYTES):
            n = batch.num_rows
            plain = np.array(batch.column("letters").to_pylist(), dtype=bool)
            names, share = np.full(n, "und", dtype=object), np.zeros(n)
            if trees is not None:
                bits = trees.lengths(*utf8(batch.column("text"))) / UNIT
                best = bits.argmin(axis=1)
                odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                names = np.where(plain, np.array(trees.langs, dtype=object)[best], "und")
                share = np.where(plain, 1 / odds, 0.0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(share, pa.float64()),
                **{c: batch.column(c) for c in carry},
            })

    kinds = dict(docs.select(*carry).dtypes)
    rows = docs.select("doc_id", "held_out", "text", *[c for c in carry if c != "text"], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, lang_pred string, score double" + "".join(f", `{c}` {kinds[c]}" for c in carry))


def identify_languages(docs: DataFrame, max_grams: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from three quarters of the labelled documents and predict the language of all.

    A row is held out if crc32 of its doc_id as text leaves 2 when divided by 4;
    rows without doc_id are neither held out nor learned from. Empty tables give
    empty results; repeated rows are learned and predicted as often as they occur.
    ``carry`` names columns that are returned as they are.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), *[c for c in carry if c not in ("text", "lang")])
    model = train(rows.filter(fold != 2), max_grams)
    return predict(rows.withColumn("held_out", F.coalesce(fold == 2, F.lit(False))), model, "language", carry)
