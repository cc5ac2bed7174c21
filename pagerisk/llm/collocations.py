"""Phrase collocations by direct-address tiling of frequency-ranked ids.

Words get ids by falling frequency. The pairs (phrase of m - 1 words, next word)
of a task are cut into tiles of ``EDGE`` by ``EDGE`` ids: a crowded tile is a
dense array counted by ``bincount``, all other pairs are sorted coordinates with
counts. Frequent phrases of m words are ranked anew and are the left side of the
next length, so a phrase is only counted if all its parts are frequent.

Of each length the ``HEAD`` most frequent phrases are known to every task by
rank. Other frequent phrases are marked in a bitmap of fixed size, get ids of
their own in a task and travel as strings; a bit set by chance costs a row that
the total count removes. Both ways give the same exact counts.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagerisk.llm.common import hot_join, mix64, settle, shuffle_parts, slices

#: Phrases of one length known by rank, the longest of them in bytes, bits of the map of the others.
HEAD, HEAD_BYTES, BITS = 1 << 16, 96, 1 << 26
#: Ids along a tile, tiles along the corner that may be dense, pairs in a batch that make a tile crowded, dense tiles of a task.
EDGE, CORNER, CROWD, DENSE = 1024, 64, 16_384, 6
#: Coordinates, ids and languages held by a task before they are summed or sent.
HELD, WORDS_HELD, LANGUAGES_HELD = 600_000, 400_000, 12
_TEXT_BYTES = 2 << 20
_BREAK = b"\xff"  # never part of UTF-8
_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
_TABLE[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 255
_TABLE = bytes(_TABLE)


def tokens_of(texts: list[str | None]) -> list[bytes]:
    """Words of all texts, A-Z in lower case, with a break between pieces and texts."""
    joined = _BREAK.join((t or "").encode() for t in texts)
    return joined.translate(_TABLE).replace(_BREAK, b" \xff ").split()


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The tokens of each language in each slice of the rows."""
    for batch in slices(batches, "text", _TEXT_BYTES):
        texts: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault("und" if lang is None else lang, []).append(text)
        for lang, own in texts.items():
            yield lang, tokens_of(own)


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, a): occurrences of every word, summed in the tasks first."""

    def send(held: dict[str, tuple[_Numbers, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (numbers, counts) in held.items():
            words = [w.decode() for w in numbers if w != _BREAK]
            of = np.delete(counts[: len(numbers)], numbers[_BREAK]) if _BREAK in numbers else counts[: len(numbers)]
            for lo in range(0, len(words), 50_000):
                part = pa.array(words[lo : lo + 50_000], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(of[lo : lo + 50_000])], ["lang", "phrase", "a"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, np.ndarray]] = {}
        for lang, tokens in by_language(batches):
            numbers, counts = held.get(lang) or (_Numbers(), np.zeros(0, np.int64))
            found = np.bincount(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)), minlength=len(counts))
            found[: len(counts)] += counts
            held[lang] = numbers, found.astype(np.int64)
            if sum(len(n) for n, _ in held.values()) > WORDS_HELD:
                yield from send(held)
                held = {}
        yield from send(held)

    return _summed(docs.mapInArrow(scan, "lang string, phrase string, a bigint"), "lang", "phrase")


def _summed(sent: DataFrame, *keys: str) -> DataFrame:
    """Sums over counts that tasks have summed already: dealt out first, so that no task builds a table that hardly shrinks."""
    return sent.repartition(*keys).groupBy(*keys).agg(F.sum("a").alias("a"))


class PairTiles:
    """Counts of pairs of ids: dense tiles where pairs crowd, sorted coordinates elsewhere."""

    def __init__(self) -> None:
        self.dense: dict[int, np.ndarray] = {}
        self.codes, self.counts, self.held = [], [], 0

    def add(self, left: np.ndarray, right: np.ndarray, dense: int = DENSE) -> None:
        """Count pairs; at most ``dense`` tiles are dense."""
        row, column = left // EDGE, right // EDGE
        corner = (row < CORNER) & (column < CORNER)
        tile = np.where(corner, row * CORNER + column, CORNER * CORNER)
        crowd = np.bincount(tile, minlength=CORNER * CORNER + 1)[:-1]
        for t in np.flatnonzero(crowd >= CROWD).tolist():
            if t not in self.dense and len(self.dense) < dense:
                self.dense[t] = np.zeros(EDGE * EDGE, np.int32)
        rest = np.ones(len(left), bool)
        for t in self.dense:
            if crowd[t]:
                here = tile == t
                self.dense[t] += np.bincount((left[here] % EDGE) * EDGE + right[here] % EDGE, minlength=EDGE * EDGE).astype(np.int32)
                rest &= ~here
        codes, counts = np.unique(left[rest] << 32 | right[rest], return_counts=True)
        self.codes.append(codes)
        self.counts.append(counts)
        self.held += len(codes)
        if self.held > HELD:
            self.squeeze()

    def squeeze(self) -> None:
        """Sum coordinates met in several batches."""
        if not self.codes:
            return
        codes, counts = np.concatenate(self.codes), np.concatenate(self.counts)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        self.codes, self.counts = [codes[starts]], [np.add.reduceat(counts[order], starts) if len(codes) else counts]
        self.held = len(starts)

    def full(self) -> bool:
        """Too many distinct coordinates for another batch."""
        return self.held > HELD // 2

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, count) of all pairs so far; starts anew."""
        self.squeeze()
        codes, counts = self.codes or [np.zeros(0, np.int64)], self.counts or [np.zeros(0, np.int64)]
        for t, cells in self.dense.items():
            at = np.flatnonzero(cells)
            left, right = t // CORNER * EDGE + at // EDGE, t % CORNER * EDGE + at % EDGE
            codes, counts = [*codes, left << 32 | right], [*counts, cells[at].astype(np.int64)]
        self.__init__()
        code = np.concatenate(codes)
        return code >> 32, code & 0xFFFFFFFF, np.concatenate(counts)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _longer_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64))


def _phrase_hash(phrase: str) -> int:
    hashes = [np.array([_word_hash(w)], np.uint64) for w in phrase.encode().split(b" ")]
    out = hashes[0]
    for h in hashes[1:]:
        out = _longer_hash(out, h)
    return int(out[0])


def frequency_map(phrases: DataFrame) -> bytes:
    """A bitmap of fixed size with the bit of every phrase set, compressed."""

    def packed(bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([pa.compress(bits.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            for phrase in batch.column("phrase").to_pylist():
                at = _phrase_hash(phrase) % BITS
                bits[at >> 3] |= 128 >> (at & 7)
        yield from packed(bits)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            for own in batch.column("bits"):
                bits |= _bits(own.as_py())
        yield from packed(bits)

    found = phrases.select("phrase").mapInArrow(mark, "bits binary")
    some = found.repartition(max(1, math.isqrt(shuffle_parts(phrases.sparkSession)))).mapInArrow(unite, "bits binary")
    whole = some.repartition(1).mapInArrow(unite, "bits binary").collect()
    return bytes(whole[0][0]) if whole else b""


def _bits(packed: bytes) -> np.ndarray:
    """The map, eight marks in a byte."""
    return np.frombuffer(pa.decompress(packed, BITS // 8, "zstd"), np.uint8) if packed else np.zeros(0, np.uint8)


def _marked(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = (marks % np.uint64(BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def ranked_head(counts: DataFrame) -> tuple[list, DataFrame, bytes]:
    """The most frequent phrases as (lang, phrase) in falling order, all others, and the map of those."""
    short = counts.filter(F.octet_length("phrase") <= HEAD_BYTES)
    order = [F.desc("a"), F.asc("lang"), F.asc("phrase")]
    found = short.orderBy(*order).limit(HEAD + 1).select("lang", "phrase", "a").toArrow().to_pylist()
    head = [(r["lang"], r["phrase"]) for r in found[:HEAD]]
    rest = counts.filter(F.octet_length("phrase") > HEAD_BYTES)
    if len(found) > HEAD:
        last = found[HEAD - 1]
        later = (F.col("a") < last["a"]) | ((F.col("a") == last["a"]) & ((F.col("lang") > last["lang"]) | ((F.col("lang") == last["lang"]) & (F.col("phrase") > last["phrase"]))))
        rest = counts.filter((F.octet_length("phrase") > HEAD_BYTES) | later)
    return head, rest, frequency_map(rest)


class _Level:
    """Phrases of one length in one language: ids from 1 for those known by rank, above them for others met in a task."""

    def __init__(self, phrases: list[bytes], shorter: _Level | None, words: _Level | None, bits: np.ndarray):
        self.phrases, self.known, self.bits = [b"", *phrases], len(phrases), bits
        self.later: list[int] = []  # hashes of the phrases not known by rank
        self.shorter, self.words = shorter, words
        if shorter is None:
            self.ids = _Words({p: i for i, p in enumerate(self.phrases) if i})
            self.ids.level = self
        else:
            cut = [p.rsplit(b" ", 1) for p in self.phrases[1:]]
            # The parts of a known phrase are frequent; those not known by rank get ids now.
            left = np.array([shorter.of(a) for a, _ in cut], np.int64)
            right = np.array([words.of(b) for _, b in cut], np.int64)
            self.codes = left << 32 | right
            order = np.argsort(self.codes)
            self.codes, self.at = self.codes[order], order + 1
            self.ids = {}

    def of(self, phrase: bytes) -> int:
        """Id of a frequent phrase given as bytes."""
        if self.shorter is None:
            if not self.ids.get(phrase):
                self.ids[phrase] = self._new(phrase, _word_hash(phrase))
            return self.ids[phrase]
        left, right = phrase.rsplit(b" ", 1)
        return int(self.extend(np.array([self.shorter.of(left)]), np.array([self.words.of(right)]), sure=True)[0])

    def _new(self, phrase: bytes, mark: int) -> int:
        self.phrases.append(phrase)
        self.later.append(mark)
        return len(self.phrases) - 1

    def number(self, word: bytes) -> int:
        """Id of a word met in a text, 0 if it cannot be frequent."""
        mark = _word_hash(word)
        at = mark % BITS
        return self._new(word, mark) if len(self.bits) and word != _BREAK and self.bits[at >> 3] >> (7 - (at & 7)) & 1 else 0

    def extend(self, left: np.ndarray, right: np.ndarray, sure: bool = False) -> np.ndarray:
        """Ids of the phrases made of shorter phrases and a next word, 0 where one is not frequent."""
        code = left << 32 | right
        out = np.zeros(len(code), np.int64)
        both = (left > 0) & (right > 0)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = both & (self.codes[at] == code)
            out[known] = self.at[at[known]]
        open_ = np.flatnonzero(both & (out == 0)) if sure or len(self.bits) else np.zeros(0, np.int64)
        if len(open_):
            codes, where = np.unique(code[open_], return_inverse=True)
            found = np.zeros(len(codes), np.int64)
            marks = _longer_hash(self.shorter.marks(codes >> 32), self.words.marks(codes & 0xFFFFFFFF))
            for i in range(len(codes)) if sure else np.flatnonzero(_marked(self.bits, marks)).tolist():
                c = int(codes[i])
                if c not in self.ids:
                    self.ids[c] = self._new(self.shorter.phrases[c >> 32] + b" " + self.words.phrases[c & 0xFFFFFFFF], int(marks[i]))
                found[i] = self.ids[c]
            out[open_] = found[where]
        return out

    @functools.cached_property
    def known_marks(self) -> np.ndarray:
        """Hashes of the phrases known by rank, by id."""
        if self.shorter is None:
            return np.array([0, *map(_word_hash, self.phrases[1 : self.known + 1])], np.uint64)
        out = np.zeros(self.known + 1, np.uint64)
        out[self.at] = _longer_hash(self.shorter.marks(self.codes >> 32), self.words.marks(self.codes & 0xFFFFFFFF))
        return out

    def marks(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of phrases by id."""
        out = self.known_marks[np.minimum(ids, self.known)]
        late = ids > self.known
        if late.any():
            out[late] = np.array(self.later, np.uint64)[ids[late] - self.known - 1]
        return out


class _Words(dict):
    """Ids of words; one that is met for the first time gets its id from the level."""

    level: _Level

    def __missing__(self, word: bytes) -> int:
        self[word] = self.level.number(word)
        return self[word]


def longer_counts(docs: DataFrame, heads: list[tuple[list, bytes]]) -> DataFrame:
    """(lang, phrase, a): occurrences of phrases one word longer than the last of ``heads``, whose parts are frequent.

    ``heads`` has (phrases by rank, map of the others) for lengths 1, 2 and so on.
    """
    spark = docs.sparkSession
    # Phrases hold no line ends, so those of a language travel as one string.
    compact = []
    for phrases, bits in heads:
        own: dict[str, list[str]] = {}
        for lang, phrase in phrases:
            own.setdefault(lang, []).append(phrase)
        compact.append(({lang: "\n".join(p).encode() for lang, p in own.items()}, bits))
    held = spark.sparkContext.broadcast(compact)
    length, known = len(heads) + 1, []

    def levels_of(lang: str) -> list[_Level]:
        levels: list[_Level] = []
        for phrases, bits in known_now():
            levels.append(_Level(phrases[lang].split(b"\n") if lang in phrases else [], levels[-1] if levels else None, levels[0] if levels else None, bits))
        return levels

    def known_now() -> list[tuple[dict[str, bytes], np.ndarray]]:
        """Ranked phrases by language and the map of the others, made once in a task."""
        if not known:
            known.extend((phrases, _bits(bits)) for phrases, bits in held.value)
        return known

    def send(lang: str, levels: list[_Level], tiles: PairTiles) -> Iterator[pa.RecordBatch]:
        left, right, count = tiles.take()
        low, word = levels[-1], levels[0]
        ranked = (left <= low.known) & (right <= word.known)
        for own in (np.flatnonzero(ranked), np.flatnonzero(~ranked)):
            for lo in range(0, len(own), 50_000):
                at = own[lo : lo + 50_000]
                n = len(at)
                if ranked[at[0]]:
                    parts = [pa.array(left[at].astype(np.int32)), pa.array(right[at].astype(np.int32)), pa.nulls(n, pa.string())]
                else:
                    texts = [(low.phrases[a] + b" " + word.phrases[b]).decode() for a, b in zip(left[at].tolist(), right[at].tolist(), strict=True)]
                    parts = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *parts, pa.array(count[at].astype(np.int64))], ["lang", "low", "word", "phrase", "a"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, tuple[list[_Level], PairTiles]] = {}
        for lang, tokens in by_language(batches):
            if lang not in state:
                if len(state) >= LANGUAGES_HELD:
                    for other, (levels, tiles) in state.items():
                        yield from send(other, levels, tiles)
                    state.clear()
                levels = levels_of(lang)
                state[lang] = levels, PairTiles()
            levels, tiles = state[lang]
            words = levels[0].ids
            ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
            if len(ids) < length:
                continue
            low = ids
            for m, level in enumerate(levels[1:], 2):
                low = level.extend(low[: len(ids) - m + 1], ids[m - 1 :])
            last = low[1:] if length > 2 else ids[1:]  # the phrase without its first word is frequent too
            low, right = low[:-1], ids[length - 1 :]
            good = (low > 0) & (right > 0) & (last > 0)
            tiles.add(low[good], right[good], DENSE - sum(len(t.dense) for _, t in state.values() if t is not tiles))
            if tiles.held > HELD // 2:
                tiles.squeeze()
            if tiles.full() or len(words) > WORDS_HELD + levels[0].known:
                yield from send(lang, levels, tiles)
                del state[lang]
        for lang, (levels, tiles) in state.items():
            yield from send(lang, levels, tiles)

    sent = docs.mapInArrow(scan, "lang string, low int, word int, phrase string, a bigint")
    return _summed(sent, "lang", "low", "word", "phrase")


def _named(counts: DataFrame, heads: list[tuple[list, bytes]]) -> DataFrame:
    """Phrases of ranked parts by their words. The names of ranked phrases are at most ``HEAD`` rows."""
    spark = counts.sparkSession

    def names(phrases: list, number: str, text: str) -> DataFrame:
        rank: dict[str, itertools.count] = {}
        rows = [(lang, next(rank.setdefault(lang, itertools.count(1))), p) for lang, p in phrases]
        table = pa.table({"lang": pa.array([r[0] for r in rows], pa.string()), number: pa.array([r[1] for r in rows], pa.int32()), text: pa.array([r[2] for r in rows], pa.string())})
        return F.broadcast(spark.createDataFrame(table))

    out = counts.join(names(heads[-1][0], "low", "left"), ["lang", "low"], "left").join(names(heads[0][0], "word", "right"), ["lang", "word"], "left")
    return out.select("lang", F.coalesce("phrase", F.concat_ws(" ", "left", "right")).alias("phrase"), "a")


def _with_frequency(rows: DataFrame, frequencies: DataFrame, part: str, name: str) -> DataFrame:
    """Adds to each row how often its part occurs; a part of very many phrases is no single task."""
    users = rows.groupBy("lang", part).agg(F.count("*").alias("users"))
    keyed = settle(users.join(frequencies.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)), ["lang", part]), "part-frequencies")
    return hot_join(rows, keyed, ["lang", part], "users").drop("users")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The strongest phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (NULL: empty) are cut at ``. , ; : ! ?`` and line ends into pieces, those
    into words at spaces and tabs, A-Z in lower case. lang NULL counts as "und".
    Candidates are phrases of 2 to ``max_words`` words inside a piece that occur
    ``a >= min_count`` times. A cut after the first words leaves parts that occur l
    and r times; score is floor(1000000 a a / (l r)) of the lowest-scoring cut, the
    earliest of equal ones. A candidate inside a longer candidate that occurs at
    least ``inside`` percent as often is dropped. The first ``top`` by score, a and
    phrase are returned. Repeated rows count repeatedly; other columns are left
    aside; an empty table gives no rows.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = settle(word_counts(rows), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.filter(F.col("a") >= min_count)
    heads, levels = [], [frequent]
    for length in range(2, max_words + 1):
        head, _, bits = ranked_head(levels[-1])
        heads.append((head, bits))
        counted = longer_counts(rows, heads).filter(F.col("a") >= min_count)
        levels.append(settle(_named(counted, heads), f"phrases-{length}"))
    every = levels[0]
    for more in levels[1:]:
        every = every.union(more)
    candidates = levels[1].withColumn("words", F.lit(2))
    for length, more in enumerate(levels[2:], 3):
        candidates = candidates.union(more.withColumn("words", F.lit(length)))

    split = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), split.alias("w")).select(
        "lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", 1, F.col("k"))).alias("first"),
        F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("rest"),
    )
    both = _with_frequency(_with_frequency(cuts, every, "first", "l"), every, "rest", "r")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top_part = (F.lit(1000000).cast("decimal(7,0)") * wide("a")).cast("decimal(19,0)") * wide("a")
    scored = both.withColumn("top", top_part).withColumn("low", wide("l") * wide("r")).withColumn("score", F.expr("top div low").cast("bigint"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.score", "cut.a", "cut.l", "cut.r")

    # The largest count of a longer candidate around each phrase.
    around = candidates.filter(F.col("words") > 2).select("lang", F.col("a").alias("outer"), split.alias("w"), "words")
    around = around.select("lang", "outer", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    around = around.select("lang", "outer", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("at"))
    around = around.select("lang", "outer", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("m"))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    left = lowest.join(around, ["lang", "phrase"], "left").filter(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * inside))

    # A first selection in parts, so that a language with most phrases is no single task.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocation_sql(min_count: int = 10, inside: int = 50, top: int = 2000) -> str:
    """The same table for phrases of 2 and 3 words in plain SQL."""
    return rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase FROM worded, (VALUES (1), (2), (3)) AS lengths(m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= {min_count}),
cuts AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM cand c, (VALUES (1), (2)) AS ks(k) WHERE k < m),
scored AS (SELECT u.lang, u.m, u.phrase, u.a, u.k, x.a AS l, y.a AS r, (1000000::HUGEINT * u.a * u.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = u.p1 JOIN f y ON y.lang = u.lang AND y.phrase = u.p2),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(a) AS outer_a FROM (
  SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM cand WHERE m = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE m = 3) GROUP BY ALL),
kept AS (SELECT o.* FROM lowest o LEFT JOIN around b USING (lang, phrase) WHERE b.outer_a IS NULL OR 100 * b.outer_a < {inside} * o.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
