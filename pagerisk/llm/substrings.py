"""Removal of byte strings that occur in documents with a smaller id, by suffix arrays over shards.

Every string of LENGTH bytes has an anchor, the 24-byte string in it with the
smallest hash. Equal strings have equal anchors at equal places, so

1. each shard of documents sends the distinct hashes of its anchors, sorted and
   cut by ranges of hashes; a range tells the shards which hashes occur in
   several documents. All other text is unique and takes no part;
2. each shard builds suffix arrays over its candidate text, in pieces of bounded
   size. Suffixes that tie for LENGTH bytes are equal strings; all but those of
   the smallest document are removed at once. What is left goes, with its
   context, to the range of its anchor;
3. a range sorts the strings of the shards, whole and window by window, keeps the
   smallest document of each, and reports which of the sent ones are not it;
4. each shard cuts the reported spans out of its documents.

A string reaches a range once per shard piece however often it occurs, so common
passages and large groups of copies stay small. What a shard sends goes out by
range when all its pieces are done, so the number of rows between shards and
ranges does not grow with the pieces. Anchors with more than HOT strings
around them do not meet as such in step 3: their strings are cut into windows of
LENGTH bytes, which meet by their own hashes and so spread over all ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerisk.llm.common import batched, discard, mix64, settle, shuffle_parts, slices, utf8
from pagerisk.llm.suffixes import suffix_groups

LENGTH, ANCHOR = 50, 24  # shorter anchors meet by chance in large corpora
#: Candidate bytes in one suffix array, and text handled at once.
PIECE, _TEXT_BYTES = 1 << 20, 1 << 18
#: Strings from which on an anchor is hot, and strings of one anchor in what goes out together from which on they are counted.
HOT, COUNTED = 20_000, 4
#: Candidate bytes of a shard, and bytes of windows of hot anchors, that go out together; bytes of one batch that is sent, and of strings merged at once.
GATHERED, WINDOWS, SENT, MERGED = 16 << 20, 16 << 20, 4 << 20, 8 << 20
_LAST = (1 << 63) - 1


def anchor_hashes(data: np.ndarray, places: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Hash of the ANCHOR bytes from every place of ``data``, or from those given, on."""
    data = np.ascontiguousarray(data)
    low, middle, high = (np.ndarray((len(data) - ANCHOR + 1,), "<u8", data, k, (1,))[places] for k in range(0, ANCHOR, 8))
    with np.errstate(over="ignore"):
        hashes = low * np.uint64(0x9E3779B97F4A7C15)
        hashes += middle * np.uint64(0xC2B2AE3D27D4EB4F)
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes += high * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(29)
    return hashes


def scrambled(hashes: np.ndarray) -> np.ndarray:
    """Smallest hashes are small: scrambled again, they fill all ranges evenly."""
    return mix64(hashes + np.uint64(1))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window start and place of every anchor, in text order; windows lie within one text."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), none, none, none
    n = len(data) - ANCHOR + 1
    hashes = anchor_hashes(data)
    # Hash above, place below: the minimum of a window names its leftmost smallest hash.
    place_bits = np.uint64(max(1, int(n).bit_length()))
    least = hashes >> place_bits
    least <<= place_bits
    least |= np.arange(n, dtype=np.uint64)
    width, done = LENGTH - ANCHOR + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    sizes = np.diff(offsets)
    real = np.zeros(len(data) + 1, np.int8)
    whole = sizes >= LENGTH
    np.add.at(real, offsets[:-1][whole], 1)
    np.add.at(real, offsets[1:][whole] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(real[: len(least)]))
    at = (least[starts] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), none, none, none
    new = np.concatenate([[True], at[1:] != at[:-1]])
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    return scrambled(hashes[at[new]]), first, last, at[new]


def range_cuts(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the ascending table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of batches with one shard each; rows come sorted by shard."""
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield int(shards[lo]), batch.slice(lo, hi - lo)


def _merged(starts: np.ndarray, ends: np.ndarray, owners: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals given in ascending order of start, as maximal runs; those of different owners, which may touch, stay apart."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    if owners is not None:
        new[1:] |= owners[1:] != owners[:-1]
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def _windows_to_spans(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the bytes that windows (row, start) cover."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + LENGTH)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(rows) - 1) if len(rows) else np.zeros(0, np.int64)
    return rows[new], starts[new], starts[last] + LENGTH


def repeats_in_piece(text: np.ndarray, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows of a piece also start in a smaller document of the piece: groups of equal strings in the suffix array."""
    found = suffix_groups(text, LENGTH)[1][windows]
    least = np.full(len(text) + 1, _LAST)
    np.minimum.at(least, found, docs)
    return docs > least[found]


def _words(data: np.ndarray, step: int = 1) -> list[np.ndarray]:
    """Eight-byte numbers that make up the LENGTH bytes from every place of ``data``, or every ``step``-th, on."""
    n = max((len(data) - LENGTH) // step + 1, 0)
    return [np.ndarray((n,), "<u8", data, k, (step,)) for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]] if n else []


def window_hashes(data: np.ndarray, step: int = 1, places: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Hash of the LENGTH bytes from every place of ``data``, or every ``step``-th, or those given, on that has as many."""
    out = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for word in (words := _words(data, step)):
            out = mix64(out ^ word[places]) * np.uint64(0x9E3779B97F4A7C15)
    return out if words else out[:0]


def _least(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each entry one of the same key that has the smallest document."""
    order = np.argsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    starts, of = np.flatnonzero(new), np.cumsum(new) - 1
    sorted_docs = docs[order]
    at = np.flatnonzero(sorted_docs == np.minimum.reduceat(sorted_docs, starts)[of])
    witness = np.empty(len(starts), np.int64)
    witness[of[at]] = order[at]
    out = np.empty(len(order), np.int64)
    out[order] = witness[of]
    return out


def repeats_in_range(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], data: np.ndarray) -> list[np.ndarray]:
    """For lists of windows (hash, document, place in ``data``), which occur in a smaller document of any list."""
    keys, docs, places = (np.concatenate(c) for c in zip(*lists, strict=True))
    if not len(keys):
        return [np.zeros(0, bool) for _ in lists]
    least = _least(keys, docs)
    found = docs > docs[least]
    hit = np.flatnonzero(found)
    here, there = places[hit], places[least[hit]]
    for w in hit[~np.logical_and.reduce([v[here] == v[there] for v in _words(data)])]:  # equal hashes of different strings: compare bytes
        text = data[places[w] : places[w] + LENGTH].tobytes()
        others = places[(keys == keys[w]) & (docs < docs[w])]
        found[w] = any(data[p : p + LENGTH].tobytes() == text for p in others)
    return np.split(found, np.cumsum([len(k) for k, _, _ in lists])[:-1])


def repeats_of_strings(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings that lie in ``data`` one behind the other, of at most 2 * LENGTH bytes each: which
    occur whole in a smaller document, and for the others string and place of each window that does.

    Of equal strings only one of the smallest document is looked into.
    """
    begin = np.cumsum(sizes) - sizes
    ends = begin + sizes - LENGTH
    key = window_hashes(data, places=begin)
    least = _least(mix64(key ^ (window_hashes(data, places=ends) << np.uint64(1))), docs)
    # First and last window make up the string. What only shares the hash stands for itself.
    equal = np.logical_and.reduce([sizes == sizes[least], *[v[p] == v[p[least]] for v in _words(data) for p in (begin, ends)]])
    least = np.where(equal, least, np.arange(len(sizes)))
    whole = docs > docs[least]
    own = np.flatnonzero(least == np.arange(len(sizes)))
    count = sizes[own] - LENGTH + 1
    before = np.cumsum(count) - count
    string = np.repeat(own, count)
    step = np.arange(int(count.sum())) - np.repeat(before, count)
    place = begin[string] + step
    found = np.flatnonzero(repeats_in_range([(window_hashes(data, places=place), docs[string], place)], data)[0])
    # Copies in the same document share what was found.
    hits = np.bincount(string[found], minlength=len(sizes))
    first = np.cumsum(hits) - hits
    of = np.flatnonzero(~whole & (hits[least] > 0))
    n = hits[least[of]]
    at = np.repeat(first[least[of]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return whole, np.repeat(of, n), step[found][at]


def repeated_windows(hashes: np.ndarray, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which windows (hash and bytes of each) also start in a smaller document of those given."""
    # The hash puts equal windows together, the bytes tell those of equal hash apart.
    order = np.lexsort((docs, windows, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (windows[order][1:] != windows[order][:-1])
    out = np.zeros(len(order), bool)
    out[order] = docs[order] > docs[order][new][np.cumsum(new) - 1]
    return out


def _batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    return batched(rows, schema, SENT)


def _divided(lists: list[np.ndarray], part: int, parts: int, n: int) -> list[np.ndarray]:
    """Bounds within ascending lists of hashes of range ``part`` of ``parts``, which cut it into ``n`` ranges."""
    cuts = np.array([((part * n + i) << 64) // (parts * n) for i in range(1, n)], np.uint64)
    return [np.array([0, *np.searchsorted(v, cuts), len(v)]) for v in lists]


def _shrunk(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _grown(blob: pa.BinaryScalar, size: int) -> np.ndarray:
    """The ``size`` bytes behind what ``_shrunk`` gave."""
    return np.frombuffer(pa.decompress(blob.as_buffer(), size, "zstd"), np.uint8)


def remove_repeats(docs: DataFrame, keep: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte covered by a LENGTH-byte string that also starts in a document with a smaller doc_id.

    Texts are UTF-8 bytes, NULL is empty, strings do not cross documents and are
    judged on the input. Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept_sha256; with ``keep`` also kept, the bytes left ("bytes")
    or their text without characters cut in half ("text"), and the columns named in ``carry`` as they are.
    Rows of one doc_id do not remove one another; rows without doc_id count as
    the largest id. Other columns are ignored, an empty table gives no rows.
    """
    parts = shuffle_parts(docs.sparkSession)
    kinds = dict(docs.select(*carry).dtypes)
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("carried"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("shard", F.pmod("row", F.lit(parts)).cast("int"))
    cuts = range_cuts(parts)
    asked_schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("hashes", pa.binary()), ("several", pa.binary())])
    known_schema = pa.schema([("shard", pa.int32()), ("hashes", pa.binary())])
    span_schema = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])

    def with_notes(notes: DataFrame | None, columns: list[str], more: tuple[str, ...] = ()) -> DataFrame:
        """Text rows of a shard in ascending order of doc_id, behind the notes for the shard."""
        texts = rows.select("shard", F.lit(1).alias("kind"), F.coalesce("doc_id", F.lit(_LAST)).alias("order"), "doc_id", "row", "text", *[F.lit(None).cast("binary").alias(c) for c in columns], *more)
        if notes is not None:
            texts = notes.select(
                "shard", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("order"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("string").alias("text"), *columns,
                *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in more],
            ).union(texts)
        return texts.repartitionById(parts, "shard").sortWithinPartitions("shard", "kind", "order")

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, hashes, owners = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if not hashes:
                return
            value, owner = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(value)
            value, owner = value[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
            value = value[starts]
            bounds = [0, *np.searchsorted(value, cuts), len(value)]
            yield from _batched(((part, shard, value[lo:hi].tobytes(), several[lo:hi].tobytes()) for part, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if hi > lo), asked_schema)

        for own, batch in _runs(batches):
            if own != shard:
                yield from flush()
                shard, hashes, owners = own, [], []
            for piece in slices(iter([batch]), "text", _TEXT_BYTES):
                data, offsets = utf8(piece.column("text"))
                value, first, _, _ = anchors(data, offsets)
                hashes.append(value)
                owners.append(piece.column("order").to_numpy()[np.searchsorted(offsets, first, "right") - 1])
        yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, several = [], []
        for batch in batches:
            for shard, h, s in zip(batch.column("shard").to_pylist(), batch.column("hashes"), batch.column("several"), strict=True):
                sent.append((shard, np.frombuffer(h.as_buffer(), np.uint64).copy()))
                several.append(sent[-1][1][np.frombuffer(s.as_buffer(), bool)])
        every = np.sort(np.concatenate([h for _, h in sent]))
        twice = every[1:][every[1:] == every[:-1]]
        repeated = np.unique(np.concatenate([twice, *several]))
        known = ((shard, h[_member(h, repeated)].tobytes()) for shard, h in sent)
        yield from _batched((row for row in known if row[1]), known_schema)

    asked = with_notes(None, []).mapInArrow(send_anchors, "part int, shard int, hashes binary, several binary")
    repeated = settle(asked.groupBy("part").applyInArrow(answer, "shard int, hashes binary"), "repeated-anchors")

    # Rows of the next step: spans for a shard, or strings for a range. Sizes of strings hold the place of the anchor in their high byte.
    sent_schema = "shard int, part int, blob binary, docs binary, row_ids binary, starts binary, sizes binary"
    sent_names = ["shard", "part", "blob", "docs", "row_ids", "starts", "sizes"]
    sent_arrow = pa.schema([(c, pa.int32() if c in ("shard", "part") else pa.binary()) for c in sent_names])

    def spans_row(shard: int, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        blob = np.stack([row, start, end]).astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([-1], pa.int32()), pa.array([blob], pa.binary()), *[pa.nulls(1, pa.binary())] * 4], sent_names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, notes, table, waiting, size = None, [], None, [], 0
        ready, ready_size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            """Suffix array over what waits; what is left of it is ready to be sent."""
            nonlocal waiting, size, ready_size
            if not waiting:
                return
            text = np.concatenate([w[0] for w in waiting])
            # Candidate segments overlap where anchors follow one another: windows are counted once.
            shift = np.cumsum([0, *[len(w[0]) for w in waiting[:-1]]])
            value, doc, row, start, first, count, place = (np.concatenate([w[k] + (s if k == 5 else 0) for w, s in zip(waiting, shift, strict=True)]) for k in (1, 2, 3, 4, 5, 6, 7))
            waiting, size = [], 0
            begin = np.cumsum(count) - count
            of = np.repeat(np.arange(len(count)), count)
            step = np.arange(int(count.sum())) - begin[of]
            found = repeats_in_piece(text, first[of] + step, doc[of])
            if found.any():
                yield spans_row(shard, *_windows_to_spans(row[of][found], (start[of] + step)[found]))
            left = np.add.reduceat(~found, begin) > 0 if len(count) else np.zeros(0, bool)
            ready.append((text, *(x[left] for x in (value, doc, row, start, first, count, place))))
            ready_size += len(text)
            if ready_size >= GATHERED:
                yield from send()

        def send() -> Iterator[pa.RecordBatch]:
            """Strings of the pieces that are ready, by the range of their anchor and there by anchor, each with its own bytes."""
            nonlocal ready, ready_size
            if not ready:
                return
            text = np.concatenate([r[0] for r in ready])
            shift = np.cumsum([0, *[len(r[0]) for r in ready[:-1]]])
            value, doc, row, start, first, count, place = (np.concatenate([r[k] + (s if k == 5 else 0) for r, s in zip(ready, shift, strict=True)]) for k in range(1, 8))
            ready, ready_size = [], 0
            order = np.argsort(value)
            value = value[order]
            anchor, strings = np.unique(value, return_counts=True)
            many = strings >= COUNTED
            bounds = [0, *np.searchsorted(value, cuts), len(order)]

            def rows_out() -> Iterator[tuple]:
                if many.any():
                    yield shard, -2, anchor[many].tobytes(), strings[many].astype("<i8").tobytes(), None, None, None
                for part, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if hi > lo:
                        chosen = order[lo:hi]
                        sizes = count[chosen] + LENGTH - 1
                        at = np.repeat(first[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                        yield shard, part, _shrunk(text[at]), *(x.tobytes() for x in (doc[chosen], row[chosen], start[chosen].astype("<i8"), (sizes | place[chosen] << 8).astype("<u2")))

            yield from _batched(rows_out(), sent_arrow)

        for own, batch in _runs(batches):
            if own != shard:
                yield from flush()
                yield from send()
                shard, notes, table = own, [], None
            kinds = batch.column("kind").to_numpy()
            notes += [np.frombuffer(h.as_buffer(), np.uint64).copy() for h in batch.column("hashes").slice(0, int((kinds == 0).sum()))]
            texts = batch.slice(int((kinds == 0).sum()))
            if not texts.num_rows:
                continue
            if table is None:
                table = np.unique(np.concatenate(notes)) if notes else np.zeros(0, np.uint64)
            for piece in slices(iter([texts]), "text", _TEXT_BYTES) if len(table) else ():
                data, offsets = utf8(piece.column("text"))
                value, first, last, place = anchors(data, offsets)
                known = _member(value, table)
                value, first, last, place = value[known], first[known], last[known], place[known]
                if not len(value):
                    continue
                doc_at = np.searchsorted(offsets, first, "right") - 1
                # Candidate text: the union of all windows, document by document.
                seg_start, seg_end = _merged(first, last + LENGTH, doc_at)
                sizes = seg_end - seg_start
                before = np.cumsum(sizes) - sizes
                text = data[np.repeat(seg_start - before, sizes) + np.arange(int(sizes.sum()))]
                seg = np.searchsorted(seg_start, first, "right") - 1
                in_text = first - seg_start[seg] + before[seg]
                orders, row_ids = piece.column("order").to_numpy(), piece.column("row").to_numpy()
                one = (text, value, orders[doc_at], row_ids[doc_at], first - offsets[doc_at], in_text, last - first + 1, place - first)
                if waiting and size + len(text) > PIECE:
                    yield from flush()
                waiting.append(one)
                size += len(text)
        yield from flush()
        yield from send()

    sent = with_notes(repeated, ["hashes"]).mapInArrow(search, sent_schema)
    found = settle(sent.withColumn("kind", F.least("part", F.lit(0))), "repeated-strings", "kind")
    discard(repeated)

    def spans_of(spans: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Spans (row, start, end) by the shards of their rows."""
        shard = spans[0] % parts
        order = np.argsort(shard)
        spans, shard = spans[:, order], shard[order]
        bounds = [*np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)]
        yield from _batched(((int(shard[lo]), spans[:, lo:hi].astype("<i8").tobytes()) for lo, hi in zip(bounds, bounds[1:], strict=False)), span_schema)

    def anchor_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return scrambled(anchor_hashes(data, begin + (size >> 8)))

    def merge(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = []
        for batch in batches:
            for blob, *columns in zip(*(batch.column(c) for c in sent_names[2:]), strict=True):
                doc, row, start, mixed = (np.frombuffer(v.as_buffer(), kind).astype(np.int64) for v, kind in zip(columns, ("<i8", "<i8", "<i8", "<u2"), strict=True))
                size = mixed & 255
                data, ends = _grown(blob, int(size.sum())), np.cumsum(size)
                sent.append((anchor_of(data, ends - size, mixed), np.append(0, ends), data, doc, row, start, size))
        # At least four steps, and as many as keep the strings of one small.
        n = max(4, -(-sum(len(x[2]) for x in sent) // MERGED))
        bounds, spans = _divided([x[0] for x in sent], part, parts, n), []
        for k in range(n):
            some = [(x, b[k], b[k + 1]) for x, b in zip(sent, bounds, strict=True) if b[k + 1] > b[k]]
            if not some:
                continue
            data = np.concatenate([x[2][x[1][lo] : x[1][hi]] for x, lo, hi in some])
            doc, row, start, size = (np.concatenate([x[c][lo:hi] for x, lo, hi in some]) for c in range(3, 7))
            whole, string, step = repeats_of_strings(data, size, doc)
            spans += [np.stack([row[whole], start[whole], (start + size)[whole]]), np.stack(_windows_to_spans(row[string], start[string] + step))]
        yield from spans_of(np.concatenate(spans, axis=1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, n in zip(batch.column("blob"), batch.column("docs"), strict=True):
                yield pa.RecordBatch.from_pydict({"anchor": np.frombuffer(anchor.as_buffer(), "<i8").copy(), "n": np.frombuffer(n.as_buffer(), "<i8").copy()})

    # What is not counted are less than COUNTED strings of an anchor each time a shard sends.
    often = found.filter("kind = -2").select("blob", "docs").mapInArrow(counted, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    hot = np.sort(np.array([r["anchor"] for r in often.filter(F.col("n") > HOT).select("anchor").collect()], np.int64).view(np.uint64))

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings of other anchors as they are; windows of the strings of hot anchors, for ranges of their own, those of many strings together."""
        waiting, size = [], 0

        def windows_out() -> Iterator[tuple]:
            hashes, windows, doc, row, start = (np.concatenate(c) for c in zip(*waiting, strict=True))
            order = np.argsort(hashes)
            bounds = [0, *np.searchsorted(hashes[order], cuts), len(order)]
            for part, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if hi > lo:
                    chosen = order[lo:hi]
                    yield -1, -1 - part, _shrunk(windows[chosen]), *(x[chosen].astype("<i8").tobytes() for x in (doc, row, start)), None

        def others(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal size
            for shard, part, *columns in zip(*(batch.column(c) for c in sent_names), strict=True):
                doc, row, start, mixed = (np.frombuffer(v.as_buffer(), kind).astype(np.int64) for v, kind in zip(columns[1:], ("<i8", "<i8", "<i8", "<u2"), strict=True))
                sizes = mixed & 255
                data, ends = _grown(columns[0], int(sizes.sum())), np.cumsum(sizes)
                is_hot = _member(anchor_of(data, ends - sizes, mixed), hot)
                cold = ~is_hot
                if not is_hot.any():
                    yield shard.as_py(), part.as_py(), *(c.as_py() for c in columns)
                    continue
                if cold.any():
                    yield shard.as_py(), part.as_py(), _shrunk(data[np.repeat(cold, sizes)]), *(x[cold].tobytes() for x in (doc, row, start.astype("<i8"), mixed.astype("<u2")))
                of = np.flatnonzero(is_hot)
                hashes = window_hashes(data)
                count = sizes[of] - LENGTH + 1
                string = np.repeat(of, count)
                step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                place = (ends - sizes)[string] + step
                waiting.append((hashes[place], data[place[:, None] + np.arange(LENGTH)], doc[string], row[string], start[string] + step))
                size += len(place) * LENGTH

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                yield from _batched(others(batch.slice(lo, 64)), sent_arrow)
                if size >= WINDOWS:
                    yield from _batched(windows_out(), sent_arrow)
                    waiting, size = [], 0
        if waiting:
            yield from _batched(windows_out(), sent_arrow)

    def merge_windows(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = []
        for batch in batches:
            for blob, *ids in zip(*(batch.column(c) for c in ("blob", "docs", "row_ids", "starts")), strict=True):
                ids = [np.frombuffer(b.as_buffer(), "<i8").copy() for b in ids]
                windows = _grown(blob, LENGTH * len(ids[0]))
                sent.append((window_hashes(windows, LENGTH), windows.view(f"S{LENGTH}"), *ids))
        n = max(4, -(-sum(LENGTH * len(x[0]) for x in sent) // MERGED))
        bounds, spans = _divided([x[0] for x in sent], part, parts, n), [np.zeros((3, 0), np.int64)]
        for k in range(n):
            some = [[c[b[k] : b[k + 1]] for c in x] for x, b in zip(sent, bounds, strict=True)]
            hashes, windows, doc, row, start = (np.concatenate(c) for c in zip(*some, strict=True))
            gone = repeated_windows(hashes, windows, doc) if len(doc) else np.zeros(0, bool)
            spans.append(np.stack(_windows_to_spans(row[gone], start[gone])))
        yield from spans_of(np.concatenate(spans, axis=1))

    def merge_part(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        yield from merge(part, batches) if part >= 0 else merge_windows(-1 - part, batches)

    strings = found.filter("kind = 0").select(*sent_names)
    if len(hot):
        # Only the ranges of hot anchors are taken apart.
        here = F.col("part").isin(np.unique(np.searchsorted(cuts, hot, "right")).tolist())
        strings = strings.filter(~here).union(strings.filter(here).mapInArrow(taken_apart, sent_schema))
    crossed = strings.groupBy("part").applyInArrow(merge_part, "shard int, blob binary")
    spans = settle(found.filter("kind = -1").select("shard", "blob").union(crossed), "repeated-spans")
    discard(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, notes, table = None, [], None
        for own, batch in _runs(batches):
            if own != shard:
                shard, notes, table = own, [], None
            kinds = batch.column("kind").to_numpy()
            notes += [np.frombuffer(b.as_buffer(), "<i8").reshape(3, -1).copy() for b in batch.column("blob").slice(0, int((kinds == 0).sum()))]
            texts = batch.slice(int((kinds == 0).sum()))
            if not texts.num_rows:
                continue
            if table is None:
                table = np.concatenate(notes, axis=1) if notes else np.zeros((3, 0), np.int64)
                table = table[:, np.lexsort((table[1], table[0]))]
            data, offsets = utf8(texts.column("text"))
            sizes, removed, runs, hashes, kept = np.diff(offsets), [], [], [], []
            for k, row in enumerate(texts.column("row").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                lo, hi = np.searchsorted(table[0], [row, row + 1]) if row < _LAST else (np.searchsorted(table[0], row), table.shape[1])
                s, e = _merged(table[1, lo:hi], table[2, lo:hi])
                if len(s):
                    mask = np.zeros(len(text) + 1, np.int8)
                    mask[s] += 1
                    mask[e] -= 1
                    text = text[np.cumsum(mask[:-1]) == 0]
                removed.append(int((e - s).sum()))
                runs.append(len(s))
                kept.append(text.tobytes())
                hashes.append(hashlib.sha256(kept[-1]).hexdigest())
            out = {
                "doc_id": texts.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(hashes, pa.string()),
            }
            if keep:
                out["kept"] = pa.array(kept, pa.binary()) if keep == "bytes" else pa.array([k.decode(errors="ignore") for k in kept], pa.string())
            for k, c in enumerate(carry):
                out[c] = texts.column("carried").field(k)
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + {None: "", "bytes": ", kept binary", "text": ", kept string"}[keep]
    schema += "".join(f", `{c}` {kinds[c]}" for c in carry)
    return with_notes(spans, ["blob"], ("carried",) if carry else ()).mapInArrow(cut, schema)
