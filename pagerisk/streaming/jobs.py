"""Structured Streaming forms of the incremental steps.

Every job reads a file stream, keeps its progress in a checkpoint folder and
writes tables; running it again adds nothing. What was seen and counted is keyed
state in the state store, combined before the shuffle, so a hot key is no burden
and no batch reads what earlier ones wrote. Histories of changed rows are compacted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagerisk.operators.audits import last_n
from pagerisk.operators.predictions import keep_one


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(query: StreamingQuery) -> None:
    """Process what is there, then stop."""
    query.awaitTermination()


#: Parts of the tally of a batch; updated batches behind which the history is compacted.
TALLIES, COMPACT_EVERY = 16, 16


def first_seen(stream: DataFrame, known: DataFrame | None, key: Column, order: Sequence[str]) -> DataFrame:
    """Keyed state of everything seen: (kind, row, fresh, n, blank) of the keys and tallies that a batch touches.

    The state store holds each key with the least row of its first batch, combined
    before the shuffle, so neither a hot key nor the master's size is felt by a
    batch. A key is fresh if its first and its last batch are one and no ``known``
    row has it; the time of a batch is logged with it, so a replay says the same.
    Rows without a key are only tallied.
    """
    names = stream.columns
    stream = stream.withColumn("_now", F.current_timestamp())
    text = F.coalesce(key.cast("string"), F.lit(""))
    row, place = F.struct(*names), F.struct(*order)
    tally = F.concat(F.col("_now").cast("string"), F.lit("|"), F.pmod(F.xxhash64(*names), F.lit(TALLIES)).cast("string"))
    entry = lambda kind, group, value, at: F.struct(F.lit(kind).alias("kind"), group.alias("group"), value.alias("row"), at.alias("place"))
    none = lambda c: F.when(F.lit(False), c)
    seen = F.array(entry("key", text, row, place), entry("tally", tally, none(row), none(place)))
    rows = stream.select("_now", (text == "").alias("blank"), F.lit(False).alias("old"), F.inline(seen)).filter("kind = 'tally' OR NOT blank")
    if known is not None:
        earlier = known.select(*names).withColumn("_now", F.current_timestamp())
        rows = rows.union(earlier.select("_now", F.lit(False), F.lit(True), F.inline(F.array(entry("key", text, row, place)))))
    grouped = rows.groupBy("kind", "group").agg(
        F.min_by("row", "place").alias("row"), F.min("_now").alias("first"), F.max("_now").alias("last"), F.bool_or("old").alias("known"),
        F.count_if(~F.col("old")).alias("n"), F.count_if("blank").alias("blank"),
    )
    return grouped.select("kind", "row", ((F.col("kind") == "key") & (F.col("first") == F.col("last")) & ~F.col("known")).alias("fresh"), "n", "blank")


def ingest(stream: DataFrame, master: str, log: str, checkpoint: str, key: Column, order: Sequence[str], known: DataFrame | None = None) -> None:
    """L1: rows whose key was never seen are appended to the master; one log row per batch.

    What was seen is kept in the state store, ``known`` (a stream of rows from
    before, read once) included; no batch reads the master. A batch is written
    under its own number, so a replay after a failure overwrites the same folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark, held = batch.sparkSession, batch.persist()
        try:
            held.filter("fresh").select("row.*").write.mode("overwrite").parquet(f"{master}/batch={number}")
            added = spark.read.schema(stream.schema).parquet(f"{master}/batch={number}").count()
            line = held.filter("kind = 'tally'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("blank"), F.lit(0)).alias("blank"))
            line.select("scanned", "blank", F.lit(added).alias("added"), F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{log}/n={number}")
        finally:
            held.unpersist()

    found = first_seen(stream, known, key, order)
    run(found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def unique_urls(stream: DataFrame, out: str, checkpoint: str, ts: str, key: str = "url", delay: str = "1 hour") -> None:
    """L2: one row per URL within the watermark; older state is dropped."""
    once = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    run(once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _folders(spark: SparkSession, out: str) -> dict[str, list[int]]:
    """Numbers of the ``base`` and ``batch`` folders that were written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    if fs.exists(path):
        for status in fs.listStatus(path):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
    return found


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def upsert(stream: DataFrame, out: str, checkpoint: str, keys: Sequence[str], every: int = COMPACT_EVERY) -> None:
    """Changed aggregate rows of each batch under its number; behind ``every`` batches they become one base.

    The history is at most one base and twice ``every`` batches. A base is written
    before what it replaces goes, and a replayed batch is overwritten, so readers
    and replays meet whole tables only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number % every == every - 1:
            newest(spark, out, keys, upto=number - 1).write.mode("overwrite").parquet(f"{out}/base={number - 1}")
            found = _folders(spark, out)
            for n in found["batch"]:
                if n < number:
                    _remove(spark, f"{out}/batch={n}")
            for n in found["base"]:
                if n < number - 1:
                    _remove(spark, f"{out}/base={n}")

    run(stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def newest(spark: SparkSession, out: str, keys: Sequence[str], upto: int | None = None) -> DataFrame:
    """The current row of each key: the last base with the batches after it."""
    found = _folders(spark, out)
    below = lambda ns: [n for n in ns if upto is None or n <= upto]
    base = max(below(found["base"]), default=-1)
    parts = [spark.read.parquet(f"{out}/base={base}").withColumn("batch", F.lit(base))] if base >= 0 else []
    parts += [spark.read.parquet(f"{out}/batch={n}").withColumn("batch", F.lit(n)) for n in sorted(below(found["batch"])) if n > base]
    if not parts:
        raise FileNotFoundError(f"no batch was written to {out}")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return keep_one(every, keys, ["batch"], last=True).drop("batch")


def breaker_counts(stream: DataFrame, key: str, outcome: str, limit: int, ts: str | None = None, forget: str | None = None) -> DataFrame:
    """L3: timeouts per domain so far and whether the domain is blocked.

    With ``ts`` and ``forget`` counts start anew in every stretch of that length, and
    the state of a stretch leaves the state store once the watermark has passed it.
    """
    late = stream.filter(F.col(outcome) == "timeout")
    if ts is None or forget is None:
        counted = late.groupBy(key).agg(F.count(F.lit(1)).alias("timeouts"))
    else:
        stretch = late.withWatermark(ts, forget).groupBy(key, F.window(ts, forget).alias("_w")).agg(F.count(F.lit(1)).alias("timeouts"))
        counted = stretch.select(key, F.col("_w.start").alias("since"), F.col("_w.end").alias("until"), "timeouts")
    return counted.withColumn("blocked", F.col("timeouts") >= limit)


def progress_counts(stream: DataFrame, ts: str, outcome: str, width: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """L4: outcomes per tumbling window, late rows within the watermark still counted."""
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), outcome).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), outcome, "n")


def extend_test_split(stream: DataFrame, assigned: str, checkpoint: str, key: str = "id", known: DataFrame | None = None) -> None:
    """Ids no split covers yet go to test. ``known`` is a stream of the ids that splits cover already."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.filter("fresh").select(f"row.{key}").withColumn("split", F.lit("test"))
        fresh.write.mode("overwrite").parquet(f"{assigned}/batch={number}")

    covered = None if known is None else known.select(key)
    found = first_seen(stream.select(key), covered, F.col(key), [key])
    run(found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def append_kpis(stream: DataFrame, out: str, checkpoint: str) -> None:
    """KPI rows appended as they come."""
    run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def recent_kpis(spark: SparkSession, out: str, ts: str = "ts", n: int = 200) -> DataFrame:
    return last_n(spark.read.parquet(out), ts, n)
