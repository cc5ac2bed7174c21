"""Hierarchical multi-length packing of documents into training sequences.

Documents longer than the context fill whole windows by themselves. What is left
of each is routed to a tier, the smallest context size that holds it. Tiers are
packed from the longest to the shortest: the gap behind a long piece takes the
longest pieces of shorter tiers that fit, and what then is open is closed with
the beginning of a shorter piece, whose rest goes back to its tier. The shortest
tier is packed by joining pieces. Only the last sequence of a block can be short;
it is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerisk.llm.common import slices

DEFAULT_MODEL = "word_bpe_49k.json"
#: Context sizes, powers of two.
TIERS = (256, 512, 1024, 2048)
#: Sequences that make up one training step.
STEP_SEQUENCES = 32
#: Text in a block: the documents that are packed together.
BLOCK_BYTES = 8 << 20
#: Words kept in a worker's cache at most; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Words of letters that are encoded as one text.
JOINED = 128
#: Words whose ids are those of their lower-case letters and of the marks behind them: letters that stay single when lower-cased,
#: and marks that begin neither a contraction nor a special string.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:;=-@\[-`{-~]*)$"
#: Normal form and words of a tokenizer for which that holds.
SPLITS_PLAIN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


class Encoder:
    """Ids of texts, joined from words that are encoded once.

    The tokenizer never joins across white space, neither in its normal form, nor
    in its words, nor in its special strings, so a text may be cut at spaces and
    line ends. Where the model marks the ends of words, plain words (letters,
    then marks) are put together from the ids of their lower-case letters and of
    their marks, and many runs of letters are encoded as one text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends = word_ends(json.loads(self.tokenizer.to_str()))
        self.known: dict[str, bytes] = {"": b""}

    def each(self, words: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def letters(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of one run of letters each, which end where the ids say so."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(group):
                raise ValueError("words and their ends differ")
            raw = ids.tobytes()
            yield from (raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False))

    def pieces(self, texts: pa.Array, encode: Callable[[list[str]], Iterator[bytes]]) -> tuple[np.ndarray, list[bytes]]:
        """For each text the number of its ids in a list of distinct ones."""
        found = texts.dictionary_encode()
        distinct = found.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        self.known.update(zip(new, encode(new), strict=True))
        return found.indices.to_numpy(), [self.known[w] for w in distinct]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word behind the other, and how many each has."""
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        cut = pc.extract_regex(words, PLAIN if self.ends is not None else "(?P<letters>a)(?P<marks>b)^")
        plain, rest = np.flatnonzero(cut.is_valid()), np.flatnonzero(cut.is_null())
        cut = cut.drop_null()
        low, letters = self.pieces(pc.utf8_lower(cut.field("letters")), self.letters)
        mark, marks = self.pieces(cut.field("marks"), self.each)
        other, others = self.pieces(words.take(pa.array(rest)), self.each)
        # Each word is two pieces: letters and marks, or all of it and nothing.
        all_pieces = [b"", *letters, *marks, *others]
        order = np.zeros((len(words), 2), np.int64)
        order[plain] = np.stack([low + 1, mark + 1 + len(letters)], axis=1)
        order[rest, 0] = other + 1 + len(letters) + len(marks)
        sizes = np.fromiter(map(len, all_pieces), np.int64, len(all_pieces)) // 4
        return gathered(np.frombuffer(b"".join(all_pieces), "<u4"), sizes, order.ravel()), sizes[order].sum(axis=1)

    def ids(self, texts: pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text behind the other and ``end`` behind each, and the offsets of the texts in them; NULL is empty."""
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        found = lists.flatten().dictionary_encode()
        data, sizes = self.words(found.dictionary)
        # The end is one more word.
        order = np.insert(found.indices.to_numpy().astype(np.int64), ends, len(sizes))
        data, sizes = np.append(data, np.array(end, "<u4")), np.append(sizes, len(end))
        reach = np.cumsum(sizes[order])
        return gathered(data, sizes, order), np.append(0, reach[ends + np.arange(len(ends))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        data, offsets = self.ids(pa.array(texts, pa.large_string()))
        return [data[lo:hi].tobytes() for lo, hi in zip(offsets, offsets[1:], strict=False)]


def gathered(data: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Stretches of ``data``, which lie in it one behind the other with the given sizes, in the asked order."""
    starts, n = (np.cumsum(sizes) - sizes)[order], sizes[order]
    before = np.cumsum(n) - n
    return data[np.repeat(starts - before, n) + np.arange(int(n.sum()))]


def word_ends(spec: dict) -> np.ndarray | None:
    """For every id whether it ends a word, for lower-case models that split letters from marks as PLAIN does; else None."""
    suffix, known = spec["model"].get("end_of_word_suffix"), (spec.get("normalizer"), spec.get("pre_tokenizer"))
    if not suffix or known != SPLITS_PLAIN:
        return None
    vocab = spec["model"]["vocab"]
    out = np.zeros(max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1, bool)
    out[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
    return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has the cores it was given
    return Encoder(path)


def pack(lengths: list[int], tiers: tuple = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length); every item is covered exactly once."""
    longest, shortest = tiers[-1], tiers[0]
    sequences: list[list[tuple[int, int, int]]] = []
    left = []
    for item, n in enumerate(lengths):
        whole = n // longest * longest
        sequences += [[(item, at, longest)] for at in range(0, whole, longest)]
        if n > whole:
            left.append((n - whole, item, whole))
    # Every pool holds (length, item, start) in ascending order.
    bounds = [0, *tiers]
    pools = [sorted(p for p in left if lo < p[0] <= hi) for lo, hi in zip(bounds, tiers, strict=False)]

    def largest(gap: int, below: int) -> tuple[int, int, int] | None:
        for pool in reversed(pools[:below]):
            at = bisect.bisect_right(pool, (gap, 1 << 60, 0))
            if at:
                return pool.pop(at - 1)
        return None

    def back(piece: tuple[int, int, int]) -> None:
        bisect.insort(pools[bisect.bisect_left(tiers, piece[0])], piece)

    loose: list[tuple[int, int, int]] = []
    for level in range(len(tiers) - 1, 0, -1):
        while pools[level]:
            n, item, start = pools[level].pop()
            row, gap = [(item, start, n)], tiers[level] - n
            while gap and (piece := largest(gap, level)):
                row.append((piece[1], piece[2], piece[0]))
                gap -= piece[0]
            if gap:  # the shortest piece left is longer than the gap: cut one
                source = next((p for p in pools[:level] if p), None)
                if source is None:
                    loose += [(length, i, at) for i, at, length in row]
                    continue
                n, item, start = source.pop()
                row.append((item, start, gap))
                back((n - gap, item, start + gap))
            sequences.append(row)
    loose += pools[0]

    # The shortest tier, and long pieces without partners: joined and cut at the context size.
    row, room = [], longest
    for n, item, start in sorted(loose, reverse=True):
        while n:
            take = min(n, room)
            row.append((item, start, take))
            start, n, room = start + take, n - take, room - take
            if not room:
                sequences.append(row)
                row, room = [], longest
    # The last one: cut at powers of two down to the shortest tier, what is then left is one short sequence.
    used, queue = longest - room, list(reversed(row))
    while used:
        size = 1 << (used.bit_length() - 1) if used >= shortest else used
        row, room = [], size
        while room:
            item, start, n = queue.pop()
            if n > room:
                queue.append((item, start + room, n - room))
                n = room
            row.append((item, start, n))
            room -= n
        sequences.append(row)
        used -= size
    return sequences


def step_groups(sizes: list[int], group: int = STEP_SEQUENCES) -> list[int]:
    """A training step for each sequence: equal numbers of sequences, and of tokens as equal as dealing them out in turns makes them."""
    steps = max(1, -(-len(sizes) // group))
    out = [0] * len(sizes)
    for place, at in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        turn, step = divmod(place, steps)
        out[at] = step if turn % 2 == 0 else steps - 1 - step
    return out


def pack_documents(docs: DataFrame, model: str = DEFAULT_MODEL, end_id: int = 1, tiers: tuple = TIERS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pack all texts: one row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document is the ids of its text and ``end_id``; NULL text is empty and has
    that one id. Rows are packed in blocks of about ``block_bytes`` of text, in
    the task that reads them: nothing is shuffled, memory is bounded by a block
    and one document. Padding to the largest tier can come from the last sequence of a block
    only, if its size is no power of two. ``tier`` is the size a sequence is
    padded to. Ids of sequences come from partition and block, so reruns on the
    same splits agree. NULL doc_id is kept; repeated rows are packed each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(public_tokenizers.path(model))
        partition, next_id, next_step = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches, "text", block_bytes):
            ids, offsets = own.ids(batch.column("text"), (end_id,))
            ids, offsets, lengths = memoryview(ids), offsets.tolist(), np.diff(offsets).tolist()
            doc_ids = batch.column("doc_id").to_pylist()
            packed = pack(lengths, tiers)
            sizes = [sum(n for _, _, n in row) for row in packed]
            steps = step_groups(sizes)
            rows = []
            for number, (row, size, step) in enumerate(zip(packed, sizes, steps, strict=True)):
                at, tier = 0, size if size & (size - 1) == 0 else tiers[-1]
                for item, start, n in row:
                    piece = ids[offsets[item] + start : offsets[item] + start + n]
                    rows.append((doc_ids[item], start, n, zlib.crc32(piece), lengths[item], (partition << 36) + next_id + number, at, tier, (partition << 36) + next_step + step))
                    at += n
            next_id += len(packed)
            next_step += max(steps, default=-1) + 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step_group bigint",
    )
