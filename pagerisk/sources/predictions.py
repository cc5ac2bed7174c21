"""Prediction tables on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagerisk.functions.mathx import logit
from pagerisk.operators.joins import settled
from pagerisk.sources.jsonl import read_tolerant

RAW_PREDICTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "page_id", "hash", "label", "prob", "p", "phish_prob", "model", "split")]
)


def _present(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def normalise(raw: DataFrame) -> DataFrame:
    """One id, label and probability per row from the field names in use, plus the logit.

    Rows without any id or any usable probability are dropped; a missing label is 0.
    """
    prob = F.coalesce("prob", "p", "phish_prob").try_cast("double")
    rows = raw.select(
        F.coalesce(_present("id"), _present("page_id"), _present("hash")).alias("id"),
        F.coalesce(F.col("label").try_cast("double").cast("int"), F.lit(0)).alias("label"),
        prob.alias("prob"),
        *[c for c in ("model", "split") if c in raw.columns],
    )
    return rows.filter("id IS NOT NULL AND prob IS NOT NULL").withColumn("logit", logit(F.col("prob")))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return normalise(read_tolerant(spark, path, RAW_PREDICTION))


def variant_choice(preds: DataFrame, precedence: Sequence[str], keys: Sequence[str] = ("model", "split")) -> DataFrame:
    """The variant kept per key: first in ``precedence`` that has rows. A small table, settled on disk."""
    rank = F.array_position(F.array(*[F.lit(v) for v in precedence]), F.col("variant"))
    seen = preds.filter(F.col("variant").isin(*precedence)).groupBy(*keys, "variant").agg(F.count(F.lit(1)).alias("n"))
    return settled(seen.groupBy(*keys).agg(F.min_by("variant", rank).alias("variant")), "variant-choice")


def choose_variant(preds: DataFrame, precedence: Sequence[str], keys: Sequence[str] = ("model", "split")) -> DataFrame:
    """Per key keep the rows of one variant only."""
    return preds.join(variant_choice(preds, precedence, keys), [*keys, "variant"], "left_semi")


PRECEDENCE = {"strict": ("base", "full"), "extended": ("full", "base"), "mixed": ("base", "full")}


def largest_files(preds: DataFrame, keys: Sequence[str] = ("model", "split")) -> DataFrame:
    """Of several files of one key and variant the one with most rows, the last name among equals."""
    sizes = preds.groupBy(*keys, "variant", "file").agg(F.count(F.lit(1)).alias("n"))
    best = settled(sizes.groupBy(*keys, "variant").agg(F.max_by("file", F.struct("n", "file")).alias("file")), "largest-files")
    return preds.join(best, [*keys, "variant", "file"], "left_semi")


def select_files(preds: DataFrame, mode: str = "extended") -> DataFrame:
    """The primary export for a mode; unknown modes are an error. With a ``file`` column the largest file counts."""
    if mode not in PRECEDENCE:
        raise ValueError(f"unknown mode: {mode}")
    return choose_variant(largest_files(preds) if "file" in preds.columns else preds, PRECEDENCE[mode])


def unchosen_full(preds: DataFrame, mode: str, keys: Sequence[str] = ("model", "split")) -> DataFrame:
    """The second output of full-variant rows beside a primary export.

    Strict: those of keys that have both variants. Mixed: all full rows, also where
    they are the primary export for want of a base. Extended: none.
    """
    if mode not in PRECEDENCE:
        raise ValueError(f"unknown mode: {mode}")
    rows = largest_files(preds, keys) if "file" in preds.columns else preds
    full = rows.filter("variant = 'full'")
    if mode == "extended":
        return full.limit(0)
    if mode == "mixed":
        return full
    based = variant_choice(rows, ("base",), keys).drop("variant")
    return full.join(based, list(keys), "left_semi")


def write_predictions(preds: DataFrame, metadata: DataFrame, path: str) -> None:
    """Rows partitioned by model and split, metadata appended beside them."""
    preds.write.mode("append").partitionBy("model", "split").parquet(f"{path}/rows")
    metadata.write.mode("append").parquet(f"{path}/metadata")


def read_head(spark: SparkSession, path: str, model: str, split: str) -> DataFrame:
    """One head by partition-pruned read; a missing head is an error, never another split."""
    rows = spark.read.parquet(f"{path}/rows").filter((F.col("model") == model) & (F.col("split") == split))
    if rows.isEmpty():
        raise FileNotFoundError(f"no predictions for model {model}, split {split}")
    return rows
