"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerisk.session import work_dir


#: Seconds between two releases of shuffle files; short steps leave little behind.
RELEASE_EVERY = 8.0
_RELEASED: dict[str, float] = {}


def shuffle_parts(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for; every bounded driver-side list is sized by it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def settle(df: DataFrame, name: str, *kinds: str) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``kinds``, and read it back.

    Cuts the lineage in a place every executor can reach, and lets the context
    cleaner remove the shuffle files of the steps before, so that the disk need
    of a chain of steps is that of its largest step and not of their sum.
    """
    spark, schema = df.sparkSession, df.schema
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").partitionBy(*kinds).parquet(path)
    if time.monotonic() - _RELEASED.get("at", 0.0) > RELEASE_EVERY:
        release(spark)
    return spark.read.schema(schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the folders of a settled table that no later step reads."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Drop references to finished plans, so that their shuffle files can go.

    Objects of the JVM that Python has let go are freed in a second round only.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    _RELEASED["at"] = time.monotonic()


#: Shares of all rows from which a join key is hot; at most as many keys are.
HOT_KEYS = 1000


def hot_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``keyed``, which has each key once and in ``count`` how many of the rows have it.

    A key with more than a thousandth of all counted rows is hot. There are
    fewer than ``HOT_KEYS`` of them, so they are broadcast and their rows stay
    where they are; all other keys are shuffled. Both inputs are read twice.
    ``how`` is "inner" or "left".
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(keyed.filter(F.col(count) * HOT_KEYS > total))
    cold = keyed.filter(F.col(count) * HOT_KEYS <= total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))


def bucket_of(column: Column, bounds: list) -> Column:
    """Index of the first bound that is >= the value (``len(bounds)`` beyond the last), by binary search.

    ``bounds`` is ascending; NULL gives 0.
    """
    n = len(bounds)
    if not n:
        return F.lit(0)
    steps, step = [], 1
    while step * 2 <= n:
        step *= 2
    while step:
        steps.append(step)
        step //= 2
    known = F.array(*[F.lit(b) for b in bounds])
    walk = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.element_at(known, F.least(at + s, F.lit(n))) < column), at + s).otherwise(at),
    )
    return F.coalesce(walk, F.lit(0))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the offsets of the texts in it; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces with about ``max_bytes`` of text each, whole rows always."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        sizes = np.nan_to_num(np.array(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.float64))
        part = (np.cumsum(sizes) // max_bytes).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def batched(rows: Iterable[tuple], schema: pa.Schema, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows in few batches with about ``max_bytes`` of binary values each; a batch costs more than its rows."""
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size >= max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (finaliser of a published generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
