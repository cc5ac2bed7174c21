"""Exact token counts of every prefix of a text, by dynamic programming over byte-pair encodings.

A byte-pair encoding of a word is determined by its prefixes: the last token of
the encoding of ``w[:i]`` is the one vocabulary entry that ends at ``i`` and
whose predecessor, the last token of what lies before it, encodes together with
it to just these two tokens. So one pass over the prefixes of a word gives the
count of every prefix. Summed over the words of a text, the counts answer how
many tokens a prefix has, or how long a prefix fits a budget, without encoding
anything again.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_MODEL = "byte_bpe_50k.json"

# The published word pattern of this family of tokenizers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept in a worker's cache at most; beyond it the cache starts anew.
CACHE_WORDS = 1_000_000
#: Pieces whose place behind a token is remembered, likewise.
SEEN_PIECES = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Counts of all prefixes of words and texts for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        vocab = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        # Every beginning of a token, and whether it is one itself.
        self.starts = {t[:i]: False for t in vocab for i in range(1, len(t))}
        self.starts.update(dict.fromkeys(vocab, True))
        self.words = regex.compile(WORDS)
        self.trees: dict[bytes, tuple[list, list] | None] = {}
        self.seen: dict[bytes, dict[bytes, int]] = {}
        self.n_seen = 0
        self.counts: dict[str, int] = {}

    def tree(self, token: bytes) -> tuple[list, list] | None:
        """How the token grows by merges: the pieces at its left and right edge, each with the rank of the merge that ends it.

        None if the token's bytes are not encoded as the token itself.
        """
        if token in self.trees:
            return self.trees[token]
        parts, left, right = [token[i : i + 1] for i in range(len(token))], [], []
        while len(parts) > 1:
            rank, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                self.trees[token] = None
                return None
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.trees[token] = ([*left, (token, 1 << 60)], [*right, (token, 1 << 60)])
        return self.trees[token]

    def together(self, before: bytes, token: bytes) -> bool:
        """True if ``before`` followed by ``token`` is encoded as just these two.

        While both grow, the pieces that touch at the border must never be
        joined: each is taken up by its own side first. Equal ranks join from
        the left.
        """
        mine = self.tree(token)
        other = self.tree(before) if before else ([], [(b"", 0)])
        known = mine is not None and other is not None
        if known and before:
            (a, ends_a), *rest_a = other[1]
            (b, ends_b), *rest_b = mine[0]
            while True:
                joins = self.rank.get((a, b), 1 << 61)
                if joins < ends_a and joins <= ends_b:
                    known = False
                    break
                if ends_a == ends_b == 1 << 60:
                    break
                if ends_a <= ends_b:
                    (a, ends_a), *rest_a = rest_a
                else:
                    (b, ends_b), *rest_b = rest_b
        return known

    def after(self, before: bytes, piece: bytes) -> int:
        """What ``piece`` can be behind the token ``before``: a token there (1), only a beginning or not allowed (0), nothing (-1)."""
        whole = self.starts.get(piece)
        return -1 if whole is None else int(whole and self.together(before, piece))

    def prefixes(self, word: bytes) -> list[int]:
        """Number of tokens of ``word[:i]`` for i = 0 .. len(word)."""
        n = len(word)
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        for start in range(n):
            before, count = last[start], counts[start] + 1
            seen = self.seen.get(before)
            if seen is None:
                seen = self.seen[before] = {}
            for end in range(start + 1, n + 1):
                piece = word[start:end]
                state = seen.get(piece)
                if state is None:
                    state = seen[piece] = self.after(before, piece)
                    self.n_seen += 1
                if state > 0:
                    counts[end], last[end] = count, piece
                elif state < 0:
                    break
            if not counts[start + 1]:
                raise ValueError("the vocabulary lacks single bytes")
        if self.n_seen > SEEN_PIECES:
            self.seen, self.n_seen = {}, 0
        return counts

    def split(self, text: str) -> Iterator[tuple[list[str], int]]:
        """Runs of ordinary words, each with the number of bytes of the special string behind it."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield self.words.findall(text[at : m.start()]), len(m[0].encode())
            at = m.end()
        yield self.words.findall(text[at:]), 0

    def count_words(self, words: list[str]) -> int:
        known = self.counts
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            for word in set(words).difference(known):
                known[word] = self.prefixes(word.encode())[-1]
        return sum(map(known.__getitem__, words))

    def count(self, text: str) -> int:
        if len(self.counts) > CACHE_WORDS:
            self.counts.clear()
        return sum(self.count_words(words) + (special > 0) for words, special in self.split(text))

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte ends of the prefixes made of whole words, and their token counts, from (0, 0) on."""
        ends, counts = [0], [0]
        for words, special in self.split(text):
            self.count_words(words)
            ends += [len(w.encode()) for w in words] + [special] * (special > 0)
            counts += [self.counts[w] for w in words] + [1] * (special > 0)
        return np.cumsum(ends), np.cumsum(counts)

    def count_prefix(self, text: str, table: tuple[np.ndarray, np.ndarray], chars: int) -> int:
        """Tokens of ``text[:chars]``: the table up to the last word whose split cannot change, and the DP of the rest."""
        prefix = text[:chars]
        n = len(prefix.encode())
        ends, counts = table
        # A cut changes no word but the one it meets and the one before (white space, a contraction, a special string).
        at = max(0, int(np.searchsorted(ends, n, "left")) - 2)
        rest = prefix.encode()[ends[at] :].decode()
        return int(counts[at]) + sum(sum(self.prefixes(w.encode())[-1] for w in words) + (s > 0) for words, s in self.split(rest))

    def fitting(self, table: tuple[np.ndarray, np.ndarray], budget: int) -> int:
        """Bytes of the longest prefix of whole words that has at most ``budget`` tokens."""
        ends, counts = table
        return int(ends[np.searchsorted(counts, budget, "right") - 1])


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, limit: int = 1024, model: str = DEFAULT_MODEL, table: bool = False) -> DataFrame:
    """Token count of every text, and what of it fits ``limit`` tokens.

    Returns doc_id, n_bytes, n_tokens, over_limit and fit_bytes (the longest
    prefix of whole words within the limit); with ``table`` also prefix_bytes
    and prefix_tokens, the ends and counts of all prefixes made of whole words.
    One map over the rows, no shuffle. NULL text counts as empty, NULL doc_id
    is kept, repeated rows give repeated results, other columns are ignored.
    """
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_bytes bigint"
    if table:
        schema += ", prefix_bytes array<bigint>, prefix_tokens array<bigint>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(public_tokenizers.path(model))
        for batch in batches:
            sizes, counts, fits, ends, cuts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                n, size = own.count(text), len(text.encode())
                full = own.table(text) if table or n > limit else None
                sizes.append(size)
                counts.append(n)
                fits.append(own.fitting(full, limit) if n > limit else size)
                if table:
                    ends.append(full[0])
                    cuts.append(full[1])
            out = {
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                "over_limit": pa.array([n > limit for n in counts], pa.bool_()), "fit_bytes": pa.array(fits, pa.int64()),
            }
            if table:
                out |= {"prefix_bytes": pa.array(ends, pa.list_(pa.int64())), "prefix_tokens": pa.array(cuts, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(out)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(count, schema)
