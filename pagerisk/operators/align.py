"""Aligning the predictions of many heads on the page id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerisk.functions.mathx import mean_of
from pagerisk.operators.joins import settled


def by_head(preds: DataFrame, heads: Sequence[str], keys: Sequence[str] = ("id",), extra: Sequence[Column] = ()) -> DataFrame:
    """One row per id, one nullable probability column per head (explicit list, one aggregate)."""
    picks = [F.max(F.when(F.col("model") == h, F.col("prob"))).alias(h) for h in heads]
    return preds.filter(F.col("model").isin(*heads)).groupBy(*keys).agg(*picks, *extra)


def present(heads: Sequence[str]) -> Column:
    """How many heads have a value."""
    total = F.lit(0)
    for h in heads:
        total = total + F.col(h).isNotNull().cast("int")
    return total


def inner_align(
    gold: DataFrame,
    preds: DataFrame,
    heads: Sequence[str],
    required: Sequence[str] | None = None,
    cheap: Sequence[str] = (),
    **_: object,
) -> DataFrame:
    """Gold rows having every required head; other missing heads are 0; label from gold."""
    need = list(required) if required is not None else list(heads)
    wide = by_head(preds, heads).filter(present(need) == len(need)) if need else by_head(preds, heads)
    return gold.select("id", "label", *cheap).join(wide, "id", "inner" if need else "left").fillna(0.0, list(heads))


def coverage_align(
    gold: DataFrame,
    preds: DataFrame,
    heads: Sequence[str],
    min_heads: int = 2,
    fill: float = 0.5,
    cheap: Sequence[str] = (),
    **_: object,
) -> DataFrame:
    """Gold rows with at least ``min_heads`` heads; missing ones get a constant."""
    wide = by_head(preds, heads).filter(present(heads) >= min_heads)
    return gold.select("id", "label", *cheap).join(wide, "id").fillna(fill, list(heads))


STRATEGIES = {"inner_join": inner_align, "coverage_max": coverage_align}


def align(strategy: str, *args, **options) -> DataFrame:
    """D3: alignment by name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown alignment strategy: {strategy}")
    return STRATEGIES[strategy](*args, **options)


def soft_impute(preds: DataFrame, heads: Sequence[str], keys: Sequence[str] = ("split",)) -> DataFrame:
    """Every id seen by any head; a missing head gets its own mean (0.5 if it has no rows); plain mean."""
    wide = by_head(preds, heads, ["id", *keys], [F.max("label").alias("label")])
    means = by_head_means(preds, heads, keys)
    filled = wide.join(settled(means, "head-means"), list(keys))
    values = [F.coalesce(F.col(h), F.col(f"mean_{h}"), F.lit(0.5)) for h in heads]
    return filled.select("id", *keys, "label", *[v.alias(h) for v, h in zip(values, heads)], mean_of(*values).alias("prob"))


def by_head_means(preds: DataFrame, heads: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(*[F.avg(F.when(F.col("model") == h, F.col("prob"))).alias(f"mean_{h}") for h in heads])


def common_ids(preds: DataFrame, heads: Sequence[str], keys: Sequence[str] = ("id",)) -> DataFrame:
    """Ids every listed head covers, with their probabilities."""
    return by_head(preds, heads, keys, [F.max("label").alias("label")]).dropna(subset=list(heads))


def covered_by_all(preds: DataFrame, heads: Sequence[str]) -> DataFrame:
    """H3: the intersection of the heads' id sets."""
    return by_head(preds, heads).filter(present(heads) == len(heads)).select("id")


def restrict_to_common(fused: DataFrame, preds: DataFrame, heads: Sequence[str]) -> DataFrame:
    """Fused rows whose id every head covers (one aggregate, one semi join)."""
    return fused.join(covered_by_all(preds, heads), "id", "left_semi")


def strict_projection(canon: DataFrame, preds: DataFrame) -> DataFrame:
    """Predictions on canonical ids only, canonical label wins."""
    canonical = canon.select("id", F.col("label").alias("canon_label"))
    joined = preds.join(canonical, "id")
    return joined.withColumn("label", F.coalesce("canon_label", "label")).drop("canon_label")


def missing_derived(preds: DataFrame, base: Sequence[str], derived: str) -> DataFrame:
    """Ids with every base head but no row of the derived model."""
    heads = [*base, derived]
    return by_head(preds, heads).filter((present(base) == len(base)) & F.col(derived).isNull()).select("id")


def explain_id(preds: DataFrame, page_id, heads: Sequence[str], base: Sequence[str], derived: str) -> DataFrame:
    """All heads of one id and a guess why the derived one is missing."""
    row = by_head(preds.filter(F.col("id") == page_id), heads)
    cause = F.when(
        (present(base) == len(base)) & F.col(derived).isNull(), F.lit("fusion_alignment_excluded_or_bug")
    ).otherwise(F.lit("unknown"))
    return row.withColumn("cause_guess", cause)


def append_missing(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Existing rows stay, new ones are added for keys not seen yet."""
    fresh = new.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return existing.unionByName(fresh)


def needs_scoring(canon: DataFrame, preds: DataFrame, model: str, usable: Column) -> DataFrame:
    """Canonical rows with usable input that the model has not scored."""
    scored = preds.filter(F.col("model") == model).select("id").distinct()
    return canon.filter(usable).join(scored, "id", "left_anti")


def heads_map(wide: DataFrame, heads: Sequence[str], fused: str = "prob") -> DataFrame:
    """Unified export with a ``heads`` map of the values present."""
    entries = F.array_compact(F.array(*[F.when(F.col(h).isNotNull(), F.struct(F.lit(h).alias("key"), F.col(h).alias("value"))) for h in heads]))
    return wide.select("id", "label", F.col(fused).alias("fused_prob"), F.map_from_entries(entries).alias("heads"))
