"""Exact linear-interpolation quantiles without gathering a column in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagerisk.operators.running import running_totals

BUCKETS_PER_UNIT = 4096


def real_bucket(x: str | Column, per_unit: int = BUCKETS_PER_UNIT) -> Column:
    """Monotone bucket of any double, of equal width on a signed log scale (under 1500 units wide)."""
    v = F.col(x) if isinstance(x, str) else x
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * per_unit).cast("int")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], bucket: Callable[[str], Column] = real_bucket
) -> DataFrame:
    """One row per (keys, prob): the linearly interpolated quantile of ``value``.

    Distinct values are counted first, ranked by cumulative counts, and only
    the rows around each requested position are kept. ``bucket`` is a monotone
    bucket that spreads the values (the default suits magnitudes).
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = running_totals(counts, keys, ["_v"], bucket("_v"), ["_n"])
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    position = lambda p: p * (F.col("total__n") - 1)
    start, stop = F.col("before__n"), F.col("before__n") + F.col("_n") - 1
    near = F.transform(wanted, lambda p: F.struct(
        p.alias("prob"),
        (position(p) - F.floor(position(p))).alias("frac"),
        ((F.floor(position(p)) >= start) & (F.floor(position(p)) <= stop)).alias("low"),
        ((F.ceil(position(p)) >= start) & (F.ceil(position(p)) <= stop)).alias("high"),
    ))
    hits = run.select(*keys, "_v", F.explode(F.filter(near, lambda s: s.low | s.high)).alias("s"))
    picked = hits.groupBy(*keys, F.col("s.prob").alias("prob")).agg(
        F.max("s.frac").alias("_f"),
        F.max(F.when(F.col("s.low"), F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("s.high"), F.col("_v"))).alias("_hi"),
    )
    return picked.select(*keys, "prob", (F.col("_lo") * (1 - F.col("_f")) + F.col("_hi") * F.col("_f")).alias("quantile"))


def quantile_grid(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """Distinct rounded values of n evenly spaced quantiles per key, ascending."""
    probs = [i / (n - 1) for i in range(n)]
    q = quantiles(df, keys, value, probs).select(*keys, F.round("quantile", 6).alias("q"))
    return q.groupBy(*keys).agg(F.array_sort(F.collect_set("q")).alias("grid"))
