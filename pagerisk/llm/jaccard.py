"""Jaccard join of shingle sets, size-aware: light sets by their subsets, heavy sets by inverted lists.

Equal sets are one node from the start. A light set (few shingles) emits the hash
of every subset that a similar set may share with it: two sets are similar just
if a subset of some size s is common to both and their sizes add up to little
enough for s, so meeting under a subset needs no further check. A heavy set is
entered in the inverted lists of its prefix, the first shingles in an order from
rare to frequent; sets that meet in a list are compared in full, in groups around
the smallest node of each list. The boundary between both is where the estimated
cost of all sets is least. Sets near the boundary go both ways.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerisk.llm.common import batched, mix64, settle, shuffle_parts, slices, utf8
from pagerisk.llm.components import connected
from pagerisk.llm.shingles import shingle_sets

#: Counters of the frequency sketch (a power of two up to 2^24), nodes compared in one group, sizes that may be light.
COUNTERS, GROUP, LIGHT_MOST = 1 << 22, 1024, 40
#: Lists up to this length count what each pair of sets shares in them; longer ones form groups around a center.
SHORT_LIST = 64
_TEXT_BYTES = 2 << 20
#: Postings that a task sends together, and bytes of postings in one batch.
POSTINGS, SENT = 1 << 20, 4 << 20
#: Bytes of light sets whose subsets go out together.
_LIGHT_BYTES = 1 << 18


def least_share(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with a similar set."""
    return -(-percent * n // 100)


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    return shingle_sets(*utf8(batch.column("text")), words)


def _signature(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


class _Firsts:
    """Tells whether an id is the smallest so far of its set, within bounded memory; a set that was forgotten is told again."""

    def __init__(self, most: int = 500_000):
        self.seen, self.most = {}, most

    def __call__(self, mark: int, doc_id: int) -> bool:
        if self.seen.get(mark, doc_id + 1) <= doc_id:
            return False
        if len(self.seen) > self.most:
            self.seen.clear()
        self.seen[mark] = doc_id
        return True


def measure(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, signature) of every row with the set itself (light) where it has LIGHT_MOST shingles or fewer,
    and the frequency sketch: counts of shingles by hash, over all rows.

    The sketch has a fixed size; tasks send it compressed, and only sums of it reach the driver.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches, "text", _TEXT_BYTES):
            sets = _sets(batch, words)
            every = np.concatenate(sets)
            np.add.at(counts, (every >> np.uint64(40)).astype(np.int64) % COUNTERS, 1)  # a table as large as the sketch for each slice would cost more than its sets
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "signature": pa.array([_signature(s) for s in sets], pa.int64()), "sketch": pa.nulls(len(sets), pa.binary()),
                "light": pa.array([s.tobytes() if 0 < len(s) <= LIGHT_MOST else None for s in sets], pa.binary()),
            })
        if counts.any():
            packed = pa.compress(counts.astype("<u4").tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(1, pa.int64()), "n_shingles": pa.nulls(1, pa.int64()), "signature": pa.nulls(1, pa.int64()), "sketch": pa.array([packed], pa.binary()), "light": pa.nulls(1, pa.binary())})

    found = settle(docs.mapInArrow(scan, "doc_id bigint, n_shingles bigint, signature bigint, sketch binary, light binary"), "shingle-sizes")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for packed in batch.column("sketch"):
                counts += np.frombuffer(pa.decompress(packed.as_buffer(), 4 * COUNTERS, "zstd"), "<u4")
        if counts.any():
            yield pa.RecordBatch.from_pydict({"sketch": pa.array([pa.compress(np.minimum(counts, (1 << 32) - 1).astype("<u4").tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    part = found.filter("sketch IS NOT NULL").select("sketch")
    sums = part.repartition(max(1, math.isqrt(shuffle_parts(docs.sparkSession)))).mapInArrow(add, "sketch binary").repartition(1).mapInArrow(add, "sketch binary").collect()
    sketch = np.frombuffer(pa.decompress(sums[0][0], 4 * COUNTERS, "zstd"), "<u4") if sums else np.zeros(COUNTERS, "<u4")
    return found.filter("sketch IS NULL").drop("sketch"), sketch


def frequency_classes(sketch: np.ndarray) -> np.ndarray:
    """0 for counters near the mean, which hold rare shingles, and one more for each doubling above it."""
    mean = max(1.0, float(sketch.mean()))
    return np.clip(np.floor(np.log2(np.maximum(sketch, 1) / (1.5 * mean))) + 1, 0, 40).astype(np.uint8)


def light_boundary(sizes: dict[int, int], percent: int) -> int:
    """Largest size treated as light: subsets of the light sets against prefixes and comparisons of the heavy ones."""
    subsets = lambda n: sum(math.comb(n, n - s) for s in range(least_share(n, percent), n + 1))
    lists = lambda n: n - least_share(n, percent) + 1 + n
    cost = {b: sum(c * (subsets(n) if n <= b else lists(n)) for n, c in sizes.items()) for b in range(LIGHT_MOST + 1)}
    return min(cost, key=lambda b: (cost[b], b))


def _subset_keys(own: np.ndarray, smallest: int) -> tuple[list[int], list[int]]:
    """Hash and size of every subset of at least ``smallest`` members."""
    with np.errstate(over="ignore"):
        terms = mix64(own ^ np.uint64(0x5851F42D4C957F2D))
        whole = np.sum(terms, dtype=np.uint64)
        keys, sizes = [], []
        for gone in range(len(own) - smallest + 1):
            if gone == 0:
                found = np.array([whole])
            else:
                out = np.array(list(itertools.combinations(range(len(own)), gone)))
                found = whole - np.sum(terms[out], axis=1, dtype=np.uint64)
            keys.append(mix64(found + np.uint64(len(own) - gone)))
            sizes += [len(own) - gone] * len(found)
    return np.concatenate(keys).astype(np.int64).tolist(), sizes


def light_links(sizes: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Links (a, b) between sets of at most ``boundary`` shingles, a spanning star for each shared subset.

    Two sets of n and m shingles that share a subset of s are similar if
    100 s >= percent (n + m - s). In a group of sets with one subset the smallest
    set is similar to all that are similar to any, so links to it are enough.
    Of equal sets a task sends the first; their copies are linked elsewhere.
    ``sizes`` is what ``measure`` found, so that no text is read again.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _Firsts()
        for batch in slices(batches, "light", _LIGHT_BYTES):
            rows = ([], [], [], [])
            for doc_id, mark, light in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "signature", "light")), strict=True):
                if first(mark, doc_id):
                    own = np.frombuffer(light, np.uint64)
                    keys, sizes_of = _subset_keys(own, least_share(len(own), percent))
                    for column, values in zip(rows, (keys, sizes_of, [len(own)] * len(keys), [doc_id] * len(keys)), strict=True):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["key", "s", "n", "doc_id"])

    light = sizes.filter((F.col("n_shingles") <= boundary) & F.col("light").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "signature", "light")
    subsets = settle(light.mapInArrow(scan, "key bigint, s bigint, n bigint, doc_id bigint"), "light-subsets")
    smallest = subsets.groupBy("key", "s").agg(F.min(F.struct("n", "doc_id")).alias("low"), F.count("*").alias("rows")).filter("rows > 1")
    pairs = subsets.join(smallest, ["key", "s"]).filter(F.col("doc_id") != F.col("low.doc_id"))
    similar = F.lit(100) * F.col("s") >= F.lit(percent) * (F.col("n") + F.col("low.n") - F.col("s"))
    return pairs.filter(similar).select(F.col("doc_id").alias("a"), F.col("low.doc_id").alias("b")).distinct()


def meetings(docs: DataFrame, words: int, percent: int, sketch: np.ndarray, boundary: int) -> DataFrame:
    """(center, node): sets that meet in inverted lists and may be similar. Only heavy sets and those near the boundary.

    A long list ties its sets to the smallest node in it. Sets that meet in short
    lists only are counted pair by pair: with c common shingles in both prefixes,
    the last at places p and q of sets of n and m, they share at most
    c + min(n - p, m - q) shingles, and most pairs fall short of similarity by that.
    A task sends its postings in a few large rows, cut by ranges of shingle
    hashes, many rows a batch; of equal sets it sends the smallest id.
    """
    parts = shuffle_parts(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(frequency_classes(sketch))
    least = -(-percent * (boundary + 1) // 100)
    posting_schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("tokens", "owners", "places", "nodes"))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, first = held.value, _Firsts()
        tokens, owners, places, nodes = [], [], [], []

        def rows_out() -> Iterator[tuple]:
            token, owner, place = map(np.concatenate, (tokens, owners, places))
            order = np.argsort(token)
            token, owner, place = token[order], owner[order], place[order]
            cuts = np.searchsorted(token, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64))
            bounds = [0, *cuts, len(token)]
            table = np.array(nodes, np.int64).reshape(-1, 3)
            for part, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if hi > lo:
                    used, own_rows = np.unique(owner[lo:hi], return_inverse=True)
                    yield part, token[lo:hi].tobytes(), own_rows.astype("<u4").tobytes(), place[lo:hi].tobytes(), table[used].tobytes()

        size = 0
        for batch in slices(batches, "text", 2 * _TEXT_BYTES):
            ids = batch.column("doc_id").to_pylist()
            for doc_id, own in zip(ids, _sets(batch, words), strict=True):
                if len(own) < least or doc_id is None:
                    continue
                mark = _signature(own)
                if not first(mark, doc_id):
                    continue
                length = len(own) - least_share(len(own), percent) + 1
                rank = classes[(own >> np.uint64(40)).astype(np.int64) % COUNTERS]
                order = np.argsort(rank, kind="stable")[:length]  # within a class by hash, as the set is sorted
                tokens.append(mix64(own[order]))  # a prefix has the small hashes of its class; scrambled, they fill all ranges evenly
                places.append(np.arange(1, length + 1, dtype=np.uint32))
                owners.append(np.full(length, len(nodes), np.uint32))
                nodes.append((doc_id, mark, len(own)))
                size += length
            if size >= POSTINGS:
                yield from batched(rows_out(), posting_schema, SENT)
                tokens, owners, places, nodes, size = [], [], [], [], 0
        if nodes:
            yield from batched(rows_out(), posting_schema, SENT)

    names = ["a", "b", "long", "n", "m", "p", "q"]

    def block(a: np.ndarray, b: np.ndarray, long: bool, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(a), 50_000):
            part = slice(lo, lo + 50_000)
            more = [pa.array(x[part].astype(np.int64)) for x in rest] or [pa.nulls(len(a[part]), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), pa.array(np.full(len(a[part]), long)), *more], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, places, tables = [], [], []
        for batch in batches:
            for t, o, p, n in zip(*(batch.column(c) for c in ("tokens", "owners", "places", "nodes")), strict=True):
                tokens.append(np.frombuffer(t.as_buffer(), np.uint64))
                places.append(np.frombuffer(p.as_buffer(), "<u4"))
                tables.append(np.frombuffer(n.as_buffer(), np.int64).reshape(-1, 3)[np.frombuffer(o.as_buffer(), "<u4")])
        token, place, table = np.concatenate(tokens), np.concatenate(places), np.concatenate(tables)
        every = np.sort(token)
        often = np.unique(every[1:][every[1:] == every[:-1]])
        if not len(often):
            return
        keep = often[np.minimum(np.searchsorted(often, token), len(often) - 1)] == token
        token, place, (node, mark, size) = token[keep], place[keep], table[keep].T
        order = np.lexsort((node, mark, token))
        order = order[np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (mark[order][1:] != mark[order][:-1])])]  # the smallest id of each set in each list
        order = order[np.lexsort((node[order], token[order]))]
        token, place, node, size = token[order], place[order], node[order], size[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lengths = np.diff([*starts, len(token)])
        far = np.repeat(lengths > SHORT_LIST, lengths)
        center = np.repeat(node[starts], lengths)
        far &= center != node
        if far.any():
            pairs = np.unique(np.stack([center[far], node[far]], axis=1), axis=0)
            yield from block(pairs[:, 0], pairs[:, 1], True)
        for length in range(2, SHORT_LIST + 1):
            rows = starts[lengths == length]
            i, j = np.triu_indices(length, 1)
            for lo in range(0, len(rows), max(1, 500_000 // len(i))):
                at = rows[lo : lo + max(1, 500_000 // len(i)), None]
                a, b = (at + i).ravel(), (at + j).ravel()
                close = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
                a, b = a[close], b[close]
                yield from block(node[a], node[b], False, size[a], size[b], place[a], place[b])

    postings = docs.mapInArrow(scan, "part int, tokens binary, owners binary, places binary, nodes binary")
    met = postings.groupBy("part").applyInArrow(meet, "a bigint, b bigint, long boolean, n bigint, m bigint, p bigint, q bigint")
    pairs = met.groupBy("a", "b").agg(
        F.max("long").alias("long"), F.count("n").alias("c"), F.max("n").alias("n"), F.max("m").alias("m"), F.max("p").alias("p"), F.max("q").alias("q"),
    )
    shared = F.col("c") + F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q"))
    possible = F.lit(100) * shared >= F.lit(percent) * (F.col("n") + F.col("m") - shared)
    return pairs.filter(F.col("long") | possible).select(F.col("a").alias("center"), F.col("b").alias("node"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(s) if s else np.zeros(0, np.uint64), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    if not len(common):
        return out
    columns = []
    for values, rows in sides:
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        known = common[at] == values
        order = np.argsort(at[known], kind="stable")
        columns.append((at[known][order], rows[known][order]))
    (a, rows_a), (b, rows_b) = columns
    for lo in range(0, len(common), 2048):
        hi = min(lo + 2048, len(common))
        blocks = []
        for at, rows, n in ((a, rows_a, len(left)), (b, rows_b, len(right))):
            part = slice(*np.searchsorted(at, [lo, hi]))
            used, row = np.unique(rows[part], return_inverse=True)
            dense = np.zeros((len(used), hi - lo), np.float32)
            dense[row, at[part] - lo] = 1
            blocks.append((used, dense))
        out[np.ix_(blocks[0][0], blocks[1][0])] += blocks[0][1] @ blocks[1][1].T
    return out


def _forest(ids: np.ndarray, alike: np.ndarray) -> list[tuple[int, int]]:
    """Links (child, parent) that span the components of a symmetric relation."""
    links, waiting = [], np.ones(len(ids), bool)
    for start in range(len(ids)):
        if not waiting[start]:
            continue
        waiting[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            near = np.flatnonzero(alike[at] & waiting)
            waiting[near] = False
            links += [(int(ids[k]), int(ids[at])) for k in near]
            queue += near.tolist()
    return links


def heavy_links(docs: DataFrame, met: DataFrame, words: int, percent: int, group: int = GROUP) -> DataFrame:
    """Links (a, b) between sets that meet, compared in full.

    The nodes around a center are compared with one another, in tiles of about
    ``group`` nodes against each other where they are more, so that a task holds
    two tiles however many sets share a list.
    """
    sizes = met.groupBy("center").agg((F.floor(F.count("*") / group) + 1).cast("int").alias("tiles"))
    members = met.select("center", "node").union(met.select("center", F.col("center").alias("node")).distinct())
    dealt = members.join(sizes, "center").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    seats = dealt.select("node", F.struct("center", "tiles", "tile").alias("seat")).withColumnRenamed("node", "doc_id")
    # Dealt out by id at every size: a few candidates more must not turn a broadcast into a shuffle of all texts.
    texts = docs.join(seats.groupBy("doc_id").agg(F.collect_list("seat").alias("seats")).hint("shuffle_hash"), "doc_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packer = zstandard.ZstdCompressor(level=3)
            packed = [packer.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "seats": batch.column("seats"), "packed": pa.array(packed, pa.binary())})

    # A text is compressed once and is then a third of its set of hashes; each group makes the sets anew.
    folded = texts.select("doc_id", "seats", "text").mapInArrow(fold, "doc_id bigint, seats array<struct<center: bigint, tiles: int, tile: int>>, packed binary")
    placed = folded.select("doc_id", "packed", F.inline("seats")).select(
        "doc_id", "packed", "center", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"),
    ).select("doc_id", "packed", "center", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, found = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            texts = pa.array([unpacker.decompress(p.as_py()).decode() for p in batch.column("packed")], pa.large_string())
            found.update(zip(batch.column("doc_id").to_pylist(), shingle_sets(*utf8(texts), words), strict=True))
        ids = np.array(sorted(found), np.int64)
        sets = [found[i] for i in ids]
        n = np.array([len(s) for s in sets], np.float64)
        shared = overlaps(sets, sets)
        alike = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
        np.fill_diagonal(alike, False)
        links = _forest(ids, alike)
        if links:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return placed.groupBy("center", "low", "high").applyInArrow(compare, "a bigint, b bigint").distinct()


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents tied by Jaccard similarity: doc_id, n_shingles, component_id.

    Words are runs of characters other than space and ASCII white space, A-Z in
    lower case; a document's set are its distinct shingles of ``words`` words,
    with fewer words the whole sequence. Documents are linked if the sets' shared
    part is at least ``percent`` of their union; component_id is the smallest
    doc_id reachable. Texts that are NULL or without words have no shingles, are
    linked with nothing and name themselves. Rows without doc_id are kept with
    NULL component_id and link nothing; rows that repeat an id must repeat its
    text, and come back as often. Sets are compared by 64-bit hashes of shingles.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes, sketch = measure(rows, words)
    known = sizes.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("signature", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    counts = {int(r["n_shingles"]): r["count"] for r in classes.filter(F.col("n_shingles") <= LIGHT_MOST).groupBy("n_shingles").count().collect()}
    boundary = light_boundary(counts, percent)
    parts = [known.join(classes.filter("rows > 1"), ["signature", "n_shingles"]).filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))]
    if boundary:
        parts.append(settle(light_links(sizes, percent, boundary), "light-links"))
    met = settle(meetings(rows, words, percent, sketch, boundary), "list-meetings")
    parts.append(settle(heavy_links(rows, met, words, percent), "heavy-links"))
    links = parts[0]
    for more in parts[1:]:
        links = links.union(more)
    tied = connected(links).withColumnRenamed("node", "doc_id")
    return sizes.join(tied, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
