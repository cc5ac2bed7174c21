"""Near-duplicate groups by one-permutation MinHash.

One hash of every shingle fills the bins of a signature: its high bits name the
bin, the smallest low bits of a bin are kept. Empty bins borrow from bins that a
hash of (bin, attempt) names until a filled one is met (optimal densification),
so short sets have whole signatures too. Runs of bins are hashed to buckets. The
members of a bucket get one edge each, to the bucket's smallest document, and
every edge is confirmed on the full sets. Only where a bucket's star does not
hold together, its members outside the center's component are compared with all
members of the star, so that no link of a bucket is lost, and a group of near
copies costs as many comparisons as it has members.

A pair at the similarity of 0.8 misses all ``BANDS`` buckets of ``ROWS`` bins
with a probability of about 2e-8, and less above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerisk.llm.common import hot_join, mix64, settle, slices, utf8
from pagerisk.llm.components import connected
from pagerisk.llm.jaccard import overlaps
from pagerisk.llm.shingles import shingle_sets

#: Bins in a bucket, buckets of a set; a set has ROWS * BANDS bins.
ROWS, BANDS = 6, 58
#: Members of a star compared in one task, and members outside the center's component compared with them.
STAR, ODD = 1024, 256
_TEXT_BYTES = 2 << 20
_EMPTY = np.uint64(1 << 32)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` minima for each set of distinct shingle hashes, densified; sets must not be empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    mixed = mix64(np.concatenate(sets) ^ np.uint64(0x2545F4914F6CDD1D))
    slot = np.repeat(np.arange(len(sets)), sizes) * bins + ((mixed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    out = np.full(len(sets) * bins, _EMPTY, np.uint64)
    np.minimum.at(out, slot, mixed & np.uint64(0xFFFFFFFF))
    filled = (out != _EMPTY).reshape(-1, bins)
    out = out.reshape(-1, bins)
    single = filled.sum(axis=1) == 1
    out[single] = out[single].min(axis=1, keepdims=True)  # every attempt ends at the only filled bin
    row, at = np.nonzero(~filled & ~single[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        with np.errstate(over="ignore"):
            probe = mix64(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt) * np.uint64(0xD1342543DE82EF95))
        source = (probe % np.uint64(bins)).astype(np.int64)
        met = filled[row, source]
        out[row[met], at[met]] = out[row[met], source[met]]
        row, at = row[~met], at[~met]
    return out


def bucket_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """Hash of every run of ``rows`` bins, apart for every band."""
    bands = minima.reshape(len(minima), -1, rows)
    factors = mix64(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = (mix64(bands + np.uint64(1)) * factors).sum(axis=2, dtype=np.uint64)
        return mix64(mixed + np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)).astype(np.int64)


def sign(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, mark, keys) of every row: size and hash of its set, buckets of the set.

    Rows without id or shingles have no buckets, nor have sets that an earlier row
    of the task with a smaller id has already: equal sets meet by their mark.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in slices(batches, "text", _TEXT_BYTES):
            sets = shingle_sets(*utf8(batch.column("text")), words)
            marks = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            chosen = []
            for i, (doc_id, mark) in enumerate(zip(batch.column("doc_id").to_pylist(), marks, strict=True)):
                if doc_id is not None and len(sets[i]) and seen.get(mark, doc_id + 1) > doc_id:
                    if len(seen) > 500_000:
                        seen.clear()  # forgotten sets get their buckets again
                    seen[mark] = doc_id
                    chosen.append(i)
            keys: list = [None] * len(sets)
            if chosen:
                for i, own in zip(chosen, bucket_keys(signatures([sets[i] for i in chosen], rows * bands), rows), strict=True):
                    keys[i] = own
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "mark": pa.array(marks, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64())),
            })

    return docs.mapInArrow(scan, "doc_id bigint, n_shingles bigint, mark bigint, keys array<bigint>")


def star_edges(signed: DataFrame, first_ids: DataFrame) -> DataFrame:
    """(center, node, cuts): an edge from every member of a bucket to its smallest, over how many tasks the bucket is dealt.

    Of equal sets only the smallest document enters the buckets.
    """
    own = signed.filter("keys IS NOT NULL").select("doc_id", "keys")
    own = settle(own.join(first_ids.withColumnRenamed("first", "doc_id").hint("shuffle_hash"), "doc_id", "left_semi"), "bucket-keys")
    spread = own.select("doc_id", F.explode("keys").alias("key"))
    buckets = spread.groupBy("key").agg(F.min("doc_id").alias("center"), F.count("*").alias("rows")).filter("rows > 1")
    buckets = settle(buckets, "buckets")
    met = hot_join(spread, buckets, ["key"], "rows").filter("doc_id <> center")
    return met.groupBy("center", F.col("doc_id").alias("node")).agg((F.floor(F.max("rows") / STAR) + 1).cast("int").alias("cuts"))


def _packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Compressed texts of the documents that take part in any comparison."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packer = zstandard.ZstdCompressor(level=3)
            packed = [packer.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "packed": pa.array(packed, pa.binary())})

    # Dealt out by id at every size: a few candidates more must not turn a broadcast into a shuffle of all texts.
    return docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(fold, "doc_id bigint, packed binary")


def _unpack(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Shingle sets of compressed texts, a bounded stretch of text at once."""
    unpacker, waiting, held = zstandard.ZstdDecompressor(), [], 0
    for packed in column:
        waiting.append(unpacker.decompress(packed.as_py()).decode())
        held += len(waiting[-1])
        if held > _TEXT_BYTES // 2:
            yield from shingle_sets(*utf8(pa.array(waiting, pa.large_string())), words)
            waiting, held = [], 0
    if waiting:
        yield from shingle_sets(*utf8(pa.array(waiting, pa.large_string())), words)


def confirm(edges: DataFrame, packed: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) whose sets are similar. A task streams members past the set of their center."""
    dealt = edges.select("center", "node", F.struct("cuts", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("cut")).alias("part"))
    seats = dealt.select(F.col("node").alias("doc_id"), "center", "part").union(
        dealt.select("center", "part").distinct().select(F.col("center").alias("doc_id"), "center", "part"),
    )
    placed = packed.join(seats, "doc_id").repartition("center", "part").withColumn("later", F.col("doc_id") != F.col("center"))
    ordered = placed.sortWithinPartitions("center", "part", "later").select("doc_id", "center", "packed")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            ids, centers = batch.column("doc_id").to_pylist(), batch.column("center").to_pylist()
            for doc_id, at, own in zip(ids, centers, _unpack(batch.column("packed"), words), strict=True):
                if doc_id == at:
                    center, held = at, own
                elif at == center and 100 * min(len(own), len(held)) >= percent * max(len(own), len(held)):
                    place = np.minimum(np.searchsorted(held, own), len(held) - 1)
                    shared = int(np.count_nonzero(held[place] == own))
                    if 100 * shared >= percent * (len(own) + len(held) - shared):
                        a.append(doc_id)
                        b.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(compare, "a bigint, b bigint")


def odd_links(edges: DataFrame, tied: DataFrame, packed: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) inside stars that did not hold together.

    ``tied`` is (node, component) of the confirmed edges. Every pair of members in
    different components has a member outside the center's component; those are
    compared with all members, in tiles of ``ODD`` by ``STAR``.
    """
    of_node, of_center = tied.select("node", F.col("component").alias("own")), tied.select(F.col("node").alias("center"), F.col("component").alias("theirs"))
    members = edges.join(of_node, "node", "left").join(of_center, "center", "left").select(
        "center", "node", (F.coalesce("own", "node") != F.coalesce("theirs", "center")).alias("odd"),
    )
    counts = members.groupBy("center").agg(F.count("*").alias("rows"), F.count_if("odd").alias("odds")).filter("odds > 0 AND rows > 1")
    counts = settle(counts, "odd-stars")
    dealt = settle(hot_join(members, counts, ["center"], "rows").select(
        "center", F.col("node").alias("doc_id"), "odd",
        (F.floor(F.col("odds") / ODD) + 1).cast("int").alias("high"), (F.floor(F.col("rows") / STAR) + 1).cast("int").alias("wide"),
    ), "odd-members")
    place = F.xxhash64("doc_id", "center")
    columns = dealt.select("doc_id", "center", F.lit(False).alias("odd"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), F.pmod(place, F.col("wide")).cast("int").alias("j"))
    rows = dealt.filter("odd").select("doc_id", "center", "odd", F.pmod(place, F.col("high")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"))
    placed = packed.join(columns.union(rows), "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, dict[int, np.ndarray]] = {True: {}, False: {}}
        for batch in batches:
            for doc_id, odd, own in zip(batch.column("doc_id").to_pylist(), batch.column("odd").to_pylist(), _unpack(batch.column("packed"), words), strict=True):
                sides[odd][doc_id] = own
        if not sides[True] or not sides[False]:
            return
        ids = [np.array(list(sides[s]), np.int64) for s in (True, False)]
        n = [np.array([len(x) for x in sides[s].values()], np.float64) for s in (True, False)]
        shared = overlaps(list(sides[True].values()), list(sides[False].values()))
        alike = 100 * shared >= percent * (n[0][:, None] + n[1][None, :] - shared)
        # The smallest document that each can reach in the tile; one link to it says as much as all pairs.
        far = np.iinfo(np.int64).max
        low = [ids[0].copy(), ids[1].copy()]
        while True:
            members = np.minimum(low[1], np.where(alike, low[0][:, None], far).min(axis=0))
            odd = np.minimum(low[0], np.where(alike, members[None, :], far).min(axis=1))
            if (members == low[1]).all() and (odd == low[0]).all():
                break
            low = [odd, members]
        a, b = np.concatenate(ids), np.concatenate(low)
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    return placed.groupBy("center", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Groups of near duplicates: doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than space and ASCII white space, A-Z in
    lower case; a document's set are its distinct shingles of ``words`` words,
    with fewer words the whole sequence. Documents of one bucket are linked if the
    shared part of their sets is at least ``percent`` of their union, confirmed on
    the full sets of 64-bit shingle hashes. component_id is the smallest doc_id
    reachable, ``kept`` tells whether that is the document itself. Texts that are
    NULL or without words have no shingles, are linked with nothing and kept. Rows
    without doc_id are linked with nothing and kept, with NULL component_id. Rows
    that repeat an id must repeat its text, and come back as often. Other columns
    are left aside. An empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(sign(plain, words, rows, bands), "signed")
    known = signed.filter("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "n_shingles", "mark")
    classes = settle(known.groupBy("mark", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "set-classes")
    edges = settle(star_edges(signed, classes.select("first")), "star-edges")
    ends = edges.select(F.col("node").alias("doc_id")).union(edges.select(F.col("center").alias("doc_id"))).distinct()
    packed = settle(_packed_texts(plain, ends), "packed-texts")
    links = settle(confirm(edges, packed, words, percent), "star-links")
    tied = settle(connected(links), "star-components")
    more = settle(odd_links(edges, tied, packed, words, percent), "odd-links")
    if not more.isEmpty():
        tied = settle(connected(links.union(more)), "all-components")
    named = classes.join(tied.withColumnRenamed("node", "first"), "first", "left").select(
        "mark", "n_shingles", "rows", F.coalesce("component", "first").alias("component"),
    )
    held = hot_join(signed.drop("keys"), settle(named, "named-classes"), ["mark", "n_shingles"], "rows", how="left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return held.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
