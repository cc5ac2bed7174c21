"""Ranked lexical search with per-term geometric blocks.

Documents are turned once into sparse vectors over the terms asked for. In shards
of documents each term's posting list is clustered by the likeness of its
documents' vectors (inner products of random projections), and each cluster, a
block, has the coordinatewise maximum of its vectors as its summary. An item's
inner product with a summary bounds the score of every document of the block, so a
block is skipped only if that bound is below a score that the item's last place is
known to reach; all other blocks are scored in full. Lists of terms that cannot
lift a document to that score by themselves are not walked. Scores are integers
and sums of exact products, so the result is that of scoring everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagerisk.llm.common import settle, slices

#: Documents of a block, coordinates of the projection, numbers in the dense vectors of a shard.
BLOCK, PROJECTED, SHARD_CELLS = 32, 16, 1 << 23
#: Documents (about) whose scores give the first lower bounds, bytes of item texts searched in one pass over the documents.
SAMPLE, ITEM_BYTES = 16_384, 1 << 20
_TEXT_BYTES = 4 << 20
_NO_ID = np.iinfo(np.int64).max
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_TABLE).split()


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: length in terms, the asked terms in it by number, how often each occurs."""
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    width = max(1, len(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(held.value)
        known[b"\xff"] = -1  # ends a text; never part of UTF-8
        get = known.get
        for batch in slices(batches, "text", _TEXT_BYTES):
            texts = b" \xff ".join((t or "").encode().translate(_TABLE) for t in batch.column("text").to_pylist())
            ids = np.array([get(t, width) for t in texts.split()], np.int64)
            ends = ids == -1
            row = np.cumsum(ends)
            n = np.bincount(row[~ends], minlength=batch.num_rows)
            asked = ~ends & (ids < width)
            code, tf = np.unique(row[asked] * width + ids[asked], return_counts=True)
            offsets = pa.array(np.searchsorted(code // width, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n.astype(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array((code % width).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64))),
            ], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(scan, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Asked:
    """Items over a vocabulary, with the weights of its terms; small, sent to the tasks."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, documents: int, length: int, k: int):
        self.weights, self.documents, self.length, self.k = weights, documents, max(1, length), k
        self.items = [np.array(own, np.int64) for own in items]
        most = max((int(weights[own].sum()) for own in self.items), default=0) * 1_000_000
        self.kind = np.float64 if most < 1 << 53 else np.int64  # sums below 2^53 are exact in doubles
        self.members: list[np.ndarray] = [[] for _ in weights]
        for i, own in enumerate(self.items):
            for t in own.tolist():
                self.members[t].append(i)
        self.members = [np.array(m, np.int64) for m in self.members]

    def dense(self, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """What each term adds to the score of each document."""
        row = np.repeat(np.arange(len(n)), np.diff(offsets))
        m = 50 + 50 * n * self.documents // self.length
        out = np.zeros((len(n), len(self.weights)), self.kind)
        out[row, terms] = self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[row]))
        return out


def blocks(likeness: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of a list's documents by block, and where blocks start: each goes to the pivot its projection is most like."""
    count = -(-len(likeness) // BLOCK)
    if count == 1:
        return np.arange(len(likeness)), np.zeros(1, np.int64)
    order = np.argsort(likeness[:, 0], kind="stable")
    pivots = likeness[order[(np.arange(count) * 2 + 1) * len(order) // (2 * count)]]
    nearest = np.argmax(likeness @ pivots.T, axis=1)
    order = np.argsort(nearest, kind="stable")
    cuts = nearest[order]
    return order, np.flatnonzero(np.concatenate([[True], cuts[1:] != cuts[:-1]]))


class Best:
    """The k best of every item so far in a task, and the score a further document must reach."""

    def __init__(self, asked: Asked, floors: np.ndarray):
        self.k, self.floors = asked.k, floors.copy()
        self.scores = [np.zeros(0, np.int64) for _ in asked.items]
        self.ids = [np.zeros(0, np.int64) for _ in asked.items]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.floors[item]) & (scores > 0)
        scores, ids = np.concatenate([self.scores[item], scores[good]]), np.concatenate([self.ids[item], ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.floors[item] = max(self.floors[item], int(scores[order[-1]]))

    def rows(self) -> pa.RecordBatch:
        ids = np.concatenate([*self.ids, np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(self.ids)), [len(i) for i in self.ids]).astype(np.int32)),
            pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([*self.scores, np.zeros(0, np.int64)])),
        ], ["item", "doc_id", "score"])


def search_shard(asked: Asked, best: Best, ids: np.ndarray, vectors_: np.ndarray, projection: np.ndarray) -> int:
    """Find the best documents of a shard for every item; gives the number of (document, item) scores computed."""
    likeness = vectors_ @ projection
    likeness /= np.maximum(np.linalg.norm(likeness, axis=1, keepdims=True), 1e-9)
    most = vectors_.max(axis=0).astype(np.int64)
    lists: dict[int, list[int]] = {}
    for i, own in enumerate(asked.items):
        own = own[most[own] > 0]
        order = own[np.argsort(most[own], kind="stable")]
        # A document with terms of this prefix only stays below the floor.
        needed = order[np.cumsum(most[order]) >= max(1, best.floors[i])]
        for t in needed.tolist():
            lists.setdefault(t, []).append(i)
    found: dict[int, list[np.ndarray]] = {}
    for t, items in lists.items():
        docs = np.flatnonzero(vectors_[:, t])
        columns = np.unique(np.concatenate([asked.items[i] for i in items]))
        wanted = np.zeros((len(columns), len(items)), asked.kind)
        for at, i in enumerate(items):
            wanted[np.searchsorted(columns, asked.items[i]), at] = 1
        order, starts = blocks(likeness[docs])
        docs = docs[order]
        own = vectors_[np.ix_(docs, columns)]
        summaries = np.maximum.reduceat(own, starts, axis=0)
        live = summaries @ wanted >= best.floors[items]
        sizes = np.diff([*starts, len(docs)])
        for at in np.flatnonzero(live.any(axis=0)).tolist():
            rows = np.flatnonzero(np.repeat(live[:, at], sizes))
            found.setdefault(items[at], []).append(docs[rows])
    scored = 0
    for i, parts in found.items():
        rows = np.unique(np.concatenate(parts))
        scores = vectors_[np.ix_(rows, asked.items[i])].sum(axis=1).astype(np.int64)
        scored += len(rows)
        best.add(i, scores, ids[rows])
    return scored


def _shards(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of whole rows, about ``SHARD_CELLS`` numbers at once."""
    most = max(1, SHARD_CELLS // max(1, len(asked.weights)))

    def joined(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        column = lambda c: whole.column(c).combine_chunks() if whole.num_rows else None
        terms, tfs = column("terms"), column("tfs")
        offsets = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
        ids = column("doc_id").fill_null(_NO_ID).to_numpy()
        return ids, asked.dense(column("n").to_numpy(), offsets, terms.flatten().to_numpy(), tfs.flatten().to_numpy())

    waiting, rows = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            piece = batch.slice(lo, most)
            if rows + piece.num_rows > most and waiting:
                yield joined(waiting)
                waiting, rows = [], 0
            waiting.append(piece)
            rows += piece.num_rows
    if rows:
        yield joined(waiting)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, selected in parts first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    some = some.withColumn("at", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("at") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _search(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(item, rank, doc_id, score) for the items, given as texts."""
    spark = docs.sparkSession
    own = [sorted(set(terms_of(t))) for t in texts]
    vocabulary = sorted({t for terms in own for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    index = settle(vectors(docs, vocabulary), "term-vectors")
    sums = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each asked term
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * sums["documents"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    asked = spark.sparkContext.broadcast(Asked([[number[t] for t in terms] for terms in own], weights, sums["documents"], sums["length"], k))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(asked.value, np.zeros(len(asked.value.items), np.int64))
        for ids, found in _shards(batches, asked.value):
            for i, terms in enumerate(asked.value.items):
                best.add(i, found[:, terms].sum(axis=1).astype(np.int64), ids)
        yield best.rows()

    schema = "item int, doc_id bigint, score bigint"
    share = max(1, sums["documents"] // SAMPLE)
    sample = index.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0).mapInArrow(every, schema)
    floors = np.zeros(len(texts), np.int64)
    for r in _top(sample, k).filter(F.col("rank") == k).collect():
        floors[r["item"]] = r["score"]
    lower = spark.sparkContext.broadcast(floors)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(asked.value, lower.value)
        projection = np.random.default_rng(11).standard_normal((len(asked.value.weights), PROJECTED))
        for ids, found in _shards(batches, asked.value):
            search_shard(asked.value, best, ids, found, projection)
        yield best.rows()

    return _top(index.mapInArrow(search, schema), k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score.

    Terms are runs of characters other than ASCII ones that are neither letters nor
    digits, A-Z in lower case; a text that is NULL has none. A term of df documents
    weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), N counting the documents with
    terms. A document of n terms has m = 50 + 50 n N div L, L being the length of
    all, and scores the sum of w (10^9 tf div (1000 tf + 20 m)) over the item's
    terms. Documents of equal score come by doc_id, those without id last; a score
    of 0 is not returned. Every row is a document of its own, also where ids
    repeat. Rows of one item_id, NULL being one, are one item with the terms of
    all. Other columns are left aside. Without documents or terms there are no rows.

    Items are searched in blocks of about ``ITEM_BYTES`` of text, each by one pass
    over the documents; only a block's items reach the driver. About ``SAMPLE``
    documents are scored in full for the first bounds; they decide what is skipped,
    never what is returned.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = items.groupBy("item_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("text"))).alias("text"))
    wanted = settle(wanted, "items")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // ITEM_BYTES))
    out = None
    for block in range(count):
        own = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == block).orderBy("item_id").collect()
        if not own:
            continue
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _search(plain, [r["text"] for r in own], k).join(F.broadcast(names), "item")
        found = found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.union(found)
    return out if out is not None else wanted.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("score")).limit(0)


def ranked_search_sql(k: int = 50) -> str:
    """The same by scoring every document, in plain SQL."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH worded AS (SELECT doc_id, len({words}) AS n, {words} AS w FROM documents WHERE text IS NOT NULL),
sums AS (SELECT count(*) FILTER (n > 0) AS docs, sum(n)::BIGINT AS total FROM worded),
postings AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM worded) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, sums GROUP BY t),
asked AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({words}) AS t FROM benchmark)),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN postings USING (t) JOIN weights USING (t), sums GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {k}"""
