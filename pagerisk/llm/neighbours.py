"""Approximate nearest neighbours by inner product along shifted Hilbert curves.

An extra coordinate makes all vectors equally long, so that the largest inner
product is the smallest distance. Several random projections to a few
dimensions, each shifted by a random offset, are laid along a Hilbert curve; all
curves together are one order of entries, cut in Spark into windows of equal
numbers of entries. A query meets the vectors of its window and of the windows
beside it on every curve; the meetings are ranked by the exact measure. How many
windows on each side is chosen by the recall of a sample of queries, whose true
neighbours are found by comparing them with all vectors.

Vectors that occur more than once are searched once: the distinct vectors are
indexed, each with the smallest ids of its copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagerisk.llm.common import bucket_of, settle, shuffle_parts

#: Curves, entries in a window, dimensions and bits of a curve's grid.
CURVES, WINDOW, DIMS, BITS = 8, 4096, 12, 5
#: Share of the sample's true neighbours that have to be met, and queries in the sample.
RECALL, SAMPLE = 0.95, 128


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid cells (rows of integers below 2^bits), by the published transposition method."""
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        low = q - np.uint32(1)
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(high, low, 0).astype(np.uint32) ^ swap
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[-1] & q) > 0, q - np.uint32(1), 0).astype(np.uint32)
        q >>= np.uint32(1)
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> np.uint32(bit)) & np.uint32(1)).astype(np.int64)
    return key


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part: id known, vector neither NULL, zero nor with NULL or non-finite components.

    Vectors of another length than the most frequent one (ties: the longest) take no part either.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vector") == (size["d"] if size else 0))


def _moments(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Mean and variance of every coordinate, and the largest length, over all vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"), len(batch.column("vector")[0]))
                yield pa.RecordBatch.from_pydict({"n": [len(x)], "s": [x.sum(0)], "ss": [(x * x).sum(0)], "most": [float((x * x).sum(1).max())]})

    rows = vectors.select("vector").mapInArrow(sums, "n bigint, s array<double>, ss array<double>, most double")
    whole = rows.select("n", "most", F.posexplode(F.arrays_zip("s", "ss")).alias("at", "v")).groupBy("at").agg(
        F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("v.s").alias("s"), F.sum("v.ss").alias("ss"),
    ).orderBy("at").collect()
    if not whole:
        return None
    n = whole[0]["n"]
    mean = np.array([r["s"] for r in whole]) / n
    return mean, np.maximum(np.array([r["ss"] for r in whole]) / n - mean * mean, 0), float(np.sqrt(max(r["most"] for r in whole)))


def _entries(reps: DataFrame, asked: DataFrame, curves: int, seed: int) -> DataFrame | None:
    """(place, query, rep): each distinct vector on each curve, those asked for a second time as queries."""
    found = _moments(reps)
    if found is None:
        return None
    mean, variance, longest = found
    dims = len(mean)
    rng = np.random.default_rng(seed)
    kept = min(DIMS, dims + 1)
    turns, shifts = [], []
    for _ in range(curves):
        turns.append(np.linalg.qr(rng.normal(size=(dims + 1, dims + 1)))[0][:, :kept])
        shifts.append(rng.random(kept))
    center = np.append(mean, 0.0)
    spread = [np.sqrt(np.maximum((t**2).T @ np.append(variance, variance.mean() + 1e-12), 1e-30)) for t in turns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, query = _matrix(batch.column("vector"), dims), batch.column("query").to_numpy(zero_copy_only=False)
            norm = np.sqrt((x * x).sum(1))
            x = np.where(query[:, None], x * (longest / norm)[:, None], x)
            x = np.hstack([x, np.where(query, 0.0, np.sqrt(np.maximum(longest**2 - norm**2, 0)))[:, None]]) - center
            for curve, (turn, shift, scale) in enumerate(zip(turns, shifts, spread, strict=True)):
                at = np.clip((x @ turn / scale + 3) / 6, 0, 1) * 0.5 + shift * 0.5
                key = hilbert_keys(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)
                yield pa.RecordBatch.from_pydict({"place": pa.array(key + (curve << 60)), "query": batch.column("query"), "rep": batch.column("rep")})

    both = reps.select("rep", "vector", F.lit(False).alias("query")).unionByName(asked.select("rep", "vector", F.lit(True).alias("query")))
    return both.mapInArrow(place, "place bigint, query boolean, rep bigint")


def _windows(entries: DataFrame, window: int) -> DataFrame:
    """Entries with the number of their window in the order of place: exact ranks from counts of ranges and ranks inside them."""
    spark = entries.sparkSession
    n = 4 * shuffle_parts(spark)
    cuts = entries.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    ranged = entries.withColumn("range", bucket_of(F.col("place"), sorted(set(cuts))))
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # a few per shuffle partition
    before, total = {}, 0
    for r in sorted(counts):
        before[r], total = total, total + counts[r]
    offset = F.element_at(F.create_map(*[F.lit(v) for r, b in before.items() for v in (r, b)]), F.col("range"))
    rank = F.row_number().over(W.partitionBy("range").orderBy("place", "rep", "query")) - 1 + offset
    return ranged.select("query", "rep", F.floor(rank / window).cast("bigint").alias("window"))


def _true_neighbours(reps: DataFrame, sample: list, k: int) -> list[tuple[int, int]]:
    """(asked, rep): the ``k`` distinct vectors nearest to each of the sample, without itself, by comparison with all."""
    names, asking = np.array([r["rep"] for r in sample], np.int64), np.array([r["vector"] for r in sample])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, found = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                rep = batch.column("rep").to_numpy()
                more = np.where(names[:, None] == rep, -np.inf, asking @ _matrix(batch.column("vector"), asking.shape[1]).T)
                scores, found = np.hstack([scores, more]), np.hstack([found, np.tile(rep, (len(names), 1))])
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                scores, found = np.take_along_axis(scores, top, 1), np.take_along_axis(found, top, 1)
        real = scores > -np.inf
        yield pa.RecordBatch.from_pydict({"asked": np.repeat(names, real.sum(1)), "rep": found[real], "score": scores[real]})

    near = reps.select("rep", "vector").mapInArrow(best, "asked bigint, rep bigint, score double")
    at = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "rep"))
    return [(r["asked"], r["rep"]) for r in near.withColumn("at", at).filter(F.col("at") <= k).select("asked", "rep").collect()]


def _reach(dealt: DataFrame, pairs: list[tuple[int, int]], recall: float) -> int:
    """Windows on each side within which a query meets the share ``recall`` of the pairs (asked, rep), at least 1."""
    if not pairs:
        return 1
    places: dict[tuple[int, bool], list[int]] = {}
    for r in dealt.filter(F.col("rep").isin(sorted({i for pair in pairs for i in pair}))).collect():
        places.setdefault((r["rep"], r["query"]), []).append(r["window"])
    apart = sorted(int(np.abs(np.subtract.outer(places[asked, True], places[rep, False])).min()) for asked, rep in pairs)
    return max(1, apart[min(max(math.ceil(recall * len(apart)), 1), len(apart)) - 1])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, curves: int = CURVES, window: int = WINDOW, seed: int = 11,
            id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest found for every query, a row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Candidates are all rows but those of the query's own id; nearness is the
    inner product in double precision, ties go to the smaller id. Rows that take
    no part are neither asked nor found (see ``usable``). Repeated rows count
    once, rows of one id with different vectors are separate candidates. Fewer
    candidates than ``k`` give fewer rows, an empty table none.

    Queries reach as many windows as it takes to meet the share ``recall`` of the
    true neighbours of ``sample`` queries, chosen by hash; all windows if need be.
    A task ranks at most ``window`` vectors and the queries of three windows. Work
    grows with the rows times ``curves`` times the windows reached.
    """
    spark = vectors.sparkSession
    rows = settle(usable(vectors, id_column, vector_column), "vectors")
    few = W.partitionBy("vector").orderBy("vec_id")
    # Each distinct vector keeps the smallest ids of its copies: one more than asked, for the query itself.
    reps = settle(
        rows.withColumn("order", F.dense_rank().over(few)).filter(F.col("order") <= k + 1)
        .groupBy("vector").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
        .withColumn("rep", F.struct("rep", "vector")).select(F.xxhash64("rep.vector", "rep.rep").alias("rep"), "vector", "ids"),
        "distinct-vectors",
    )
    queries = rows.filter(F.col("vec_id") % every == 0).distinct().join(reps.select("rep", "vector"), "vector").select("vec_id", "rep")
    queries = settle(queries.withColumnRenamed("vec_id", "query_id"), "queries")
    asked = queries.select("rep").distinct().join(reps.select("rep", "vector"), "rep")
    entries = _entries(reps, asked, curves, seed)
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if entries is None:
        return spark.createDataFrame([], result)
    dealt = settle(_windows(settle(entries, "curve-entries"), window), "curve-windows")
    chosen = asked.orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    reach = _reach(dealt, _true_neighbours(reps, chosen, k) if chosen else [], recall)
    # Queries come in blocks of three windows, and a window's vectors once for each block.
    last = dealt.agg(F.max("window")).first()[0] or 0
    beside = F.sequence(F.greatest(F.lit(-reach).cast("bigint"), -F.col("window")), F.least(F.lit(reach).cast("bigint"), last - F.col("window")))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.lit(2 * reach // 3).cast("bigint"))
    met = dealt.select(
        "rep", "query", F.explode(
            F.when(F.col("query"), F.transform(beside, lambda d: F.struct((F.col("window") + d).alias("window"), F.floor((d + reach) / 3).cast("bigint").alias("block"))))
            .otherwise(F.transform(blocks, lambda b: F.struct(F.col("window").alias("window"), b.alias("block"))))
        ).alias("at"),
    ).select("rep", "query", "at.window", "at.block").join(reps.select("rep", "vector"), "rep")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        query, rep = table["query"].to_numpy(), table["rep"].to_numpy()
        if query.all() or not query.any():
            return
        x = _matrix(table["vector"].chunk(0), len(table["vector"][0]))
        # Small tables have several curves in one window.
        once = lambda part: part[np.unique(rep[part], return_index=True)[1]]
        data, asks = once(np.flatnonzero(~query)), once(np.flatnonzero(query))
        own, own_rep = x[data], rep[data]
        for lo in range(0, len(asks), 256):
            asking, names = x[asks[lo : lo + 256]], rep[asks[lo : lo + 256]]
            scores = asking @ own.T
            # All that tie with the last place stay in, rows of equal score are told apart later by id.
            n = min(k + 1, len(own))
            last = np.partition(scores, -n, axis=1)[:, -n] - 1e-9 * np.abs(scores).max(axis=1)
            q, c = np.nonzero(scores >= last[:, None])
            exact = np.einsum("ij,ij->i", asking[q], own[c])
            yield pa.RecordBatch.from_pydict({"asked": pa.array(names[q]), "rep": pa.array(own_rep[c]), "score": pa.array(exact)})

    pairs = met.groupBy("window", "block").applyInArrow(rank, "asked bigint, rep bigint, score double").groupBy("asked", "rep").agg(F.max("score").alias("score"))
    named = pairs.join(reps.select("rep", "ids"), "rep").select("asked", "score", F.element_at("ids", 1).alias("first"), "ids")
    best = named.withColumn("at", F.row_number().over(W.partitionBy("asked").orderBy(F.desc("score"), "first"))).filter(F.col("at") <= k + 1)
    # At most k + 1 vectors with k + 1 ids each: bounded lists.
    lists = best.select("asked", F.explode("ids").alias("vec_id"), "score").groupBy("asked").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "vec_id"))), 1, k + 1).alias("found"),
    )
    answers = queries.join(lists.withColumnRenamed("asked", "rep"), "rep").select(
        "query_id", F.posexplode(F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)).alias("at", "f"),
    )
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.below")).alias("score"))
