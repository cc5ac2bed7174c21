"""Join helpers: hot keys are salted, small sides are settled so their size is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerisk.session import materialise

#: Keys named hot at most, and counters of the sketch that finds them.
HOT_MOST, TRACKED = 200, 10_000


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """A derived frame written once to the shared folder.

    Spark then plans joins with its true file size: below the broadcast
    threshold the other side is not shuffled, above it a shuffle join is used.
    """
    return materialise(df, name)


def hot_keys(rows: DataFrame, keys: Sequence[str], parts: int) -> list[int]:
    """Hashes of the keys that own more than a fair share of the rows, by a frequent-items sketch.

    A key is hot above a quarter of one of ``parts`` equal parts. The sketch has a
    fixed size and never misses a key that frequent; at most ``HOT_MOST`` come back.
    """
    known = rows.filter(F.concat_ws("", *[F.col(k).cast("string") for k in keys]) != "") if keys else rows
    top = known.select(F.xxhash64(*keys).alias("k")).agg(F.expr(f"approx_top_k(k, {HOT_MOST}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    return [r["item"] for r in top["top"] or [] if r["count"] * 4 * parts > top["n"]]


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    row_key: str | Column,
    how: str = "left",
    salts: int = 16,
) -> DataFrame:
    """Equi-join where a few keys may own much of ``facts``; ``dim`` holds one row per key.

    Only hot keys are split into ``salts`` parts by a hash of the row key, and only
    their dimension rows are repeated; all others are joined as they are.
    """
    row = F.col(row_key) if isinstance(row_key, str) else row_key
    hot = hot_keys(facts, keys, salts)
    if not hot:
        return facts.join(dim, list(keys), how)
    is_hot = F.xxhash64(*keys).isin(hot)
    left = facts.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")).otherwise(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = dim.withColumn("_salt", F.explode(every))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def fill_only(df: DataFrame, computed: dict[str, Column]) -> DataFrame:
    """Computed values fill missing columns, existing non-null values stay."""
    have = set(df.columns)
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in have else v for c, v in computed.items()})
