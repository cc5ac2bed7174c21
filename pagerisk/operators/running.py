"""Cumulative sums and ranks that never put a whole group into one task.

A plain window over ``partitionBy(model)`` sends every row of a model to one
task. Here the order is cut into buckets by a monotone expression of the order
column: a window runs inside each bucket, a second one runs over the bucket
totals (a bounded number of rows), and the two are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_bucket"
SCORE_BUCKETS_PER_UNIT = 256
_EDGE_BUCKET = 1_000_000


def score_bucket(score: str | Column, per_unit: int = SCORE_BUCKETS_PER_UNIT) -> Column:
    """A monotone bucket of a probability, equally fine near 0, 1/2 and 1.

    Buckets have equal width on the logit scale, which a double can span over
    less than 1500 units, so at most about ``1500 * per_unit`` buckets exist.
    """
    p = F.col(score) if isinstance(score, str) else score
    logit = F.log(p / (F.lit(1.0) - p))
    return (
        F.when(p <= 0.0, F.lit(-_EDGE_BUCKET))
        .when(p >= 1.0, F.lit(_EDGE_BUCKET))
        .otherwise(F.floor(logit * per_unit).cast("int"))
    )


def hash_bucket(hex_digest: str | Column) -> Column:
    """Bucket of a hex digest: its first four digits, evenly filled, 65 536 buckets."""
    h = F.col(hex_digest) if isinstance(hex_digest, str) else hex_digest
    return F.conv(F.substring(h, 1, 4), 16, 10).cast("int")


def int_bucket(value: str | Column, width: int = 1 << 17) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(v / F.lit(width)).cast("long")


def even_bucket(df: DataFrame, column: str, rows: int = 1 << 17, most: int = 4096) -> Column:
    """A monotone bucket with about ``rows`` rows each, from quantiles of the data.

    ``most`` bounds the list of cuts, not the rows: beyond ``rows * most`` rows
    the buckets grow. Values may be sparse; the bucket is found by binary search.
    """
    n = df.count()
    parts = min(most, -(-n // rows))
    if parts < 2:
        return F.lit(0)
    cuts = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    known, steps = F.array(*map(F.lit, cuts)), []
    step = 1 << max(0, len(cuts).bit_length() - 1)
    while step:
        steps.append(F.lit(step))
        step >>= 1

    def walk(at: Column, by: Column) -> Column:
        ahead = at + by
        return F.when((ahead <= len(cuts)) & (F.element_at(known, F.least(ahead, F.lit(len(cuts)))) < F.col(column)), ahead).otherwise(at)

    return F.coalesce(F.aggregate(F.array(*steps), F.lit(0), walk), F.lit(0)) if cuts else F.lit(0)


def place_bucket(df: DataFrame, column: str) -> Column:
    """Bucket of a reading position: the file block of (file, block, row), else even buckets of a number."""
    if df.schema[column].dataType.typeName() == "struct":
        return F.struct(F.col(f"{column}.file"), F.col(f"{column}.block"))
    return even_bucket(df, column)


def time_bucket(ts: str | Column, seconds: int = 3600) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Sequence[str],
    descending: bool = False,
) -> DataFrame:
    """Add ``before_x`` (sum over strictly earlier rows) and ``total_x`` for each x in ``sums``.

    ``order`` must be unique within ``keys``, and ``bucket`` monotone in its
    first column. The running sum including the row itself is ``before_x + x``.
    """
    keys = list(keys)
    direction = F.desc if descending else F.asc
    cut = df.withColumn(_BUCKET, bucket)
    part = [*keys, _BUCKET]

    inside = (
        Window.partitionBy(*part)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums])

    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = whole.orderBy(direction(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = cut.groupBy(*part).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    offsets = per_bucket.select(
        *part,
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    joined = local.join(offsets, part)
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"before_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
    )


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """Row numbers 1..n within ``keys``, with the group size as ``<name>_of``."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    run = running_totals(one, keys, order, bucket, ["_one"], descending)
    return run.select(
        *df.columns,
        (F.col("before__one") + 1).alias(name),
        F.col("total__one").alias(f"{name}_of"),
    )


def hash_ranked(
    df: DataFrame,
    key: str,
    seed: int | str,
    keys: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """Deterministic shuffle order: rank by md5 of ``seed|key``, ties by the key.

    The digest spreads any key evenly, so each bucket stays small. The same
    order can be written in any SQL engine.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    tmp = df.withColumn("_digest", digest)
    out = ranked(tmp, keys, ["_digest", key], hash_bucket("_digest"), name)
    return out.drop("_digest")


def lagged(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    columns: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """Values of the previous row in order, even when one key owns most rows.

    ``lag`` runs inside each bucket; the first row of a bucket takes the last
    row of the nearest earlier bucket that has any.
    """
    keys = list(keys)
    part = [*keys, _BUCKET]
    cut = df.withColumn(_BUCKET, bucket)
    inside = Window.partitionBy(*part).orderBy(*order)
    row = F.struct(*columns)
    local = cut.select("*", F.lag(row).over(inside).alias("_prev"), F.row_number().over(inside).alias("_rn"))
    ends = cut.groupBy(*part).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_BUCKET)
    before = ends.select(*part, F.lag("_last").over(across).alias("_edge"))
    joined = local.join(before, part)
    prev = F.when(F.col("_rn") == 1, F.col("_edge")).otherwise(F.col("_prev"))
    return joined.select(*df.columns, *[prev[c].alias(f"{prefix}{c}") for c in columns])
