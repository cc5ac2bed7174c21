"""Row-level work on prediction tables: validation, names, duplicates, orientation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerisk.functions.mathx import logit
from pagerisk.operators import metrics as m
from pagerisk.operators.joins import settled
from pagerisk.sources.jsonl import CORRUPT

KEYS = ("model", "split")


def validation_report(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One aggregate over parsed lines (``id, label, prob, _corrupt_record``)."""
    good = F.col(CORRUPT).isNull()
    missing = {c: F.count_if(good & F.col(c).isNull()) for c in ("id", "label", "prob")}
    errors = F.count_if(~good)
    for c in missing.values():
        errors = errors + c
    rows_ok = F.count_if(good)
    unique = F.count_distinct(F.when(good, F.col("id")))
    lo, hi = F.min("prob"), F.max("prob")
    return rows.groupBy(*keys).agg(
        F.count_if(~good).alias("bad_json"),
        *[c.alias(f"missing_{n}") for n, c in missing.items()],
        rows_ok.alias("predictions"),
        unique.alias("unique_ids"),
        (rows_ok != unique).alias("has_duplicates"),
        F.count_if(F.col("label") == 1).alias("label_1"),
        F.count_if(F.col("label") == 0).alias("label_0"),
        lo.alias("min_prob"),
        hi.alias("max_prob"),
        ((lo < 0) | (hi > 1)).alias("out_of_range"),
        (errors == 0).alias("valid"),
    )


def require_valid(rows: DataFrame) -> DataFrame:
    """The rows themselves, or an error naming what is wrong."""
    report = validation_report(rows).first()
    if not report.valid:
        raise ValueError(f"invalid predictions: {report.asDict()}")
    return rows.drop(CORRUPT)


# Model names kept as they are, and the folder names of each head.
KNOWN_MODELS = ("dom", "js_code", "url", "text", "fusion", "meta_fusion")
FOLDER_MODELS = {
    "markup_run": "dom",
    "js_codet5p": "js_code",
    "fusion": "fused",
    "fusion_covmax": "fused_covmax",
    "fusion_soft": "fused_soft",
    "fusion_meta": "meta_fused",
    "url_head": "url",
    "text_head": "text",
    "js_charcnn": "js_charcnn_base",
    "js_charcnn_aug": "js_charcnn_aug",
    "cheap_mlp": "cheap_mlp",
}


def model_name(name: Column) -> Column:
    """An unknown model whose name contains ``markup`` is the DOM head."""
    return F.when(~name.isin(*KNOWN_MODELS) & name.contains("markup"), F.lit("dom")).otherwise(name)


def model_of_folder(folder: Column) -> Column:
    """Head name of a prediction folder, NULL when the folder is not one of ours."""
    out = F.lit(None).cast("string")
    for k, v in FOLDER_MODELS.items():
        out = F.when(folder == k, F.lit(v)).otherwise(out)
    return out


def order_key(order: Sequence[str]) -> Column:
    """One ordering value; a single column stays primitive, which lets Spark aggregate by hash."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """first (or last) row per key as a partial aggregate, safe when one key owns most rows."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = pick(F.struct(*rest), order_key(order))
    return df.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def keep_ends(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """first and last row per key, named by ``kept``, from one shuffle of the rows.

    Each column is picked for itself by the same order, so that numbers stay in
    plain buffers, which Spark aggregates by hash; equal orders pick the same row.
    """
    at, rest = order_key(order), [c for c in df.columns if c not in keys]
    pick = {"first": F.min_by, "last": F.max_by}
    best = df.groupBy(*keys).agg(*[pick[e](F.col(c), at).alias(f"_{e}_{c}") for e in pick for c in rest])
    rows = F.array(*[F.struct(F.lit(e).alias("kept"), *[F.col(f"_{e}_{c}").alias(c) for c in rest]) for e in pick])
    return best.select(*keys, F.inline(rows)).select("kept", *df.columns)


def dedup_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows before, after and removed."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.sum(F.col("n") - 1).alias("removed"),
        F.count_if(F.col("n") > 1).alias("duplicated_ids"),
    )


def aggregate_duplicates(preds: DataFrame, order: Sequence[str], keys: Sequence[str] = ("model", "id")) -> DataFrame:
    """Mean probability and logit per (model, id), label of the first row, row count."""
    return preds.groupBy(*keys).agg(
        F.avg("prob").alias("prob"),
        F.avg(logit(F.col("prob"))).alias("logit"),
        F.min_by("label", order_key(order)).alias("label"),
        F.count(F.lit(1)).alias("duplicate_count"),
    )


def orientation(preds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Area and flip flag per key; undefined area never flips."""
    auc = m.score_curve(preds, keys).groupBy(*keys).agg(m.roc_auc_expr().alias("raw_auc"), F.first("tot_n").alias("n"))
    flip = F.coalesce(F.col("raw_auc") < 0.5, F.lit(False))
    return auc.select(
        *keys, "n", "raw_auc", flip.alias("flipped"),
        F.when(flip, F.lit(1.0) - F.col("raw_auc")).otherwise(F.col("raw_auc")).alias("auc"),
    )


def auto_flip(preds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Heads ranked the wrong way round are turned (1 - p)."""
    flags = settled(orientation(preds, keys).select(*keys, "flipped"), "orientation")
    turned = preds.join(flags, list(keys), "left")
    return turned.withColumn("prob", F.when(F.col("flipped"), F.lit(1.0) - F.col("prob")).otherwise(F.col("prob")))
