"""Leak-safe splits by time and group, cutoff searches, stratified fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagerisk.operators.joins import salted_join, settled
from pagerisk.operators.quantiles import quantiles
from pagerisk.operators.running import hash_bucket, hash_ranked, int_bucket, ranked, running_totals, time_bucket

MICROS = 1_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds of the wall-clock time since 1970."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def hour_bucket(us: str) -> Column:
    return int_bucket(us, 3600 * MICROS)


def percentile_cutoff(df: DataFrame, ts: str, pct: float) -> DataFrame:
    """Linearly interpolated time cutoff, in microseconds since the epoch."""
    rows = df.select(micros(ts).cast("double").alias("us"))
    return quantiles(rows, [], "us", [min(max(pct, 0.0), 100.0) / 100.0], hour_bucket).select(F.col("quantile").alias("cutoff_us"))


def _assign(df: DataFrame, groups: DataFrame, group: str, ts: str, cutoff, key: str) -> DataFrame:
    """Rows after the cutoff are test; earlier ones follow their group (``groups``: group, in_val)."""
    late = F.col(ts) > cutoff
    early = salted_join(df.filter(~late), groups, [group], key)
    side = F.when(F.coalesce("in_val", F.lit(False)), "val").otherwise("train")
    return early.withColumn("split", side).drop("in_val").unionByName(df.filter(late).withColumn("split", F.lit("test")))


def time_group_split(
    df: DataFrame, group: str, ts: str, cutoff: Column, val_frac: float = 0.1, seed: int = 42,
    key: str = "id", strict_groups: bool = False,
) -> DataFrame:
    """Test is everything after the cutoff; earlier groups are ranked by hash and the first share goes to val.

    ``strict_groups`` drops test rows whose group also occurs before the cutoff.
    """
    groups = df.filter(F.col(ts) <= cutoff).select(group).distinct()
    r = hash_ranked(groups, group, seed)
    chosen = r.select(group, (F.col("rank") <= F.bround(F.lit(val_frac) * F.col("rank_of"))).alias("in_val"))
    out = _assign(df, chosen, group, ts, cutoff, key)
    if strict_groups:
        known = groups.withColumn("_known", F.lit(True))
        out = salted_join(out, known, [group], key).filter((F.col("split") != "test") | F.col("_known").isNull()).drop("_known")
    return out


def group_overlap(splits: DataFrame, group: str) -> DataFrame:
    """How many groups occur in more than one split."""
    per = splits.groupBy(group).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")])
    return per.agg(F.count_if((F.col("train") == 1) & (F.col("val") == 1)).alias("train_val"),
                   F.count_if((F.col("test") == 1) & ((F.col("train") == 1) | (F.col("val") == 1))).alias("test_early"))


def counts_after(df: DataFrame, ts: str, label: str = "label") -> DataFrame:
    """for every distinct time, rows and positives strictly after it, and its index among the times."""
    per = df.groupBy(F.col(ts).alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"), F.lit(1).cast("long").alias("one"))
    run = running_totals(per, [], ["t"], time_bucket("t"), ["n", "pos", "one"], descending=True)
    return run.select("t", F.col("before_n").alias("n_after"), F.col("before_pos").alias("pos_after"),
                      (F.col("total_one") - F.col("before_one") - 1).alias("idx"))


def _by_nearness(after: DataFrame, initial: Column) -> DataFrame:
    """Candidates with their turn when walking outward from the initial cutoff, earlier side first."""
    j = settled(after.agg(F.count_if(F.col("t") <= initial).alias("j")), "cut-index").first().j
    turn = F.when(F.col("idx") < j, (F.lit(j) - 1 - F.col("idx")) * 2).otherwise((F.col("idx") - F.lit(j)) * 2 + 1)
    return after.withColumn("turn", turn)


def cutoff_with_both_classes(df: DataFrame, ts: str, initial: Column, min_pos: int = 1) -> DataFrame:
    """The nearest cutoff whose later rows hold both classes and enough positives."""
    walk = _by_nearness(settled(counts_after(df, ts), "after"), initial)
    ok = (F.col("pos_after") >= max(1, min_pos)) & (F.col("n_after") > F.col("pos_after"))
    return walk.agg(F.coalesce(F.min_by("t", F.when(ok, F.col("turn"))), initial).alias("cutoff"))


def cutoff_for_ratio(
    df: DataFrame, ts: str, initial: Column, target: float, tol: float = 0.02, min_pos: int = 1, min_total: int = 1
) -> DataFrame:
    """The nearest cutoff whose later positive share is within ``tol`` of the target, else the closest one.

    Only cuts better than the initial one count.
    """
    after = settled(counts_after(df, ts), "after")
    share = F.col("pos_after") / F.when(F.col("n_after") > 0, F.col("n_after"))
    err = F.abs(F.coalesce(share, F.lit(0.0)) - target)
    late = F.col(ts) > initial
    start = df.agg((F.count_if(late & (F.col("label") == 1)) / F.greatest(F.lit(1), F.count_if(late))).alias("r")).first().r
    err0 = abs(start - target)
    ok = (F.col("n_after") >= max(1, min_total)) & (F.col("pos_after") >= max(1, min_pos)) & (err < err0)
    rank = F.struct((err > tol).alias("far"), F.when(err > tol, err).otherwise(F.lit(0.0)).alias("err"), F.col("turn"))
    return _by_nearness(after, initial).agg(F.coalesce(F.min_by("t", F.when(ok, rank)), initial).alias("cutoff"))


def group_stats(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def val_groups(df: DataFrame, group: str, val_frac: float, seed: int = 42) -> DataFrame:
    """I5 without a target: mixed groups first, then positive-only, then negative-only, until the row target is met."""
    stats = group_stats(df, group)
    kind = F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n")), 0).when(F.col("pos") > 0, 1).otherwise(2)
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")))
    order = stats.withColumns({"_kind": kind, "_digest": digest})
    run = running_totals(order, [], ["_kind", "_digest", group], F.col("_kind") * 65536 + hash_bucket("_digest"), ["n"])
    target = F.greatest(F.lit(1), F.bround(F.lit(val_frac) * F.col("total_n")))
    return run.select(group, (F.col("before_n") < target).alias("in_val"))


def val_groups_for_ratio(df: DataFrame, group: str, val_frac: float, target: float, min_pos: int = 1, seed: int = 42) -> DataFrame:
    """I5 with a target: groups in seeded order whose joint positive share comes near the target, at any number of groups.

    Groups at or above the target share form the rich pool, the others the poor
    one. If the pools have shares R and P, a choice of W rows meets the target
    with W (target - P) / (R - P) rich rows; so many are taken in seeded order
    (more until ``min_pos`` positives are in). Poor groups then correct what the
    rich ones came to: they are taken up to the prefix that brings share and
    size nearest to their targets, |share - target| + |rows - W| / W, the
    shorter prefix on ties.
    Deviation from the source behaviour: it chooses group by group and may swap
    groups afterwards; here one cut in each pool decides.
    """
    stats = settled(group_stats(df, group), "group-stats")
    rich = F.col("pos") / F.col("n") >= F.lit(target)
    pools = stats.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        *[F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).alias(f"{name}_{c}") for name, side in (("rich", rich), ("poor", ~rich)) for c in ("n", "pos")],
    ).select(
        F.greatest(F.lit(1), F.bround(F.lit(val_frac) * F.col("rows"))).alias("want"),
        F.when(F.col("rich_n") > 0, F.col("rich_pos") / F.col("rich_n")).alias("high"),
        F.when(F.col("poor_n") > 0, F.col("poor_pos") / F.col("poor_n")).alias("low"),
    ).withColumn(
        "quota", F.when(F.col("high").isNull(), 0.0).when(F.col("low").isNull(), F.col("want"))
        .otherwise(F.col("want") * (F.lit(target) - F.col("low")) / (F.col("high") - F.col("low"))),
    )
    ordered = stats.withColumns({"_rich": rich, "_digest": F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")))})
    run = running_totals(ordered, ["_rich"], ["_digest", group], hash_bucket("_digest"), ["n", "pos"]).crossJoin(F.broadcast(pools))  # one row
    run = settled(run.select(group, "n", "pos", "_rich", "before_n", "before_pos", "want", "quota"), "group-order")
    first = F.col("_rich") & ((F.col("before_n") < F.col("quota")) | (F.col("before_pos") < F.lit(min_pos)))
    got = run.agg(F.coalesce(F.sum(F.when(first, F.col("n"))), F.lit(0)).alias("got_n"), F.coalesce(F.sum(F.when(first, F.col("pos"))), F.lit(0)).alias("got_pos"))

    def miss(n: Column, pos: Column) -> Column:
        return F.when(n > 0, F.abs(pos / n - F.lit(target)) + F.abs(n - F.col("want")) / F.col("want"))

    after_n, after_pos = F.col("before_n") + F.col("n"), F.col("before_pos") + F.col("pos")
    poor = run.filter(~F.col("_rich")).crossJoin(F.broadcast(got))  # one row
    ends = poor.select(after_n.alias("end"), miss(F.col("got_n") + after_n, F.col("got_pos") + after_pos).alias("miss"), miss(F.col("got_n"), F.col("got_pos")).alias("none"))
    end = ends.agg(F.min(F.struct("miss", "end")).alias("best"), F.min("none").alias("none")).select(
        F.when(F.col("none").isNotNull() & (F.col("none") <= F.col("best.miss")), 0).otherwise(F.coalesce("best.end", F.lit(0))).alias("end"),
    )
    return run.crossJoin(F.broadcast(end)).select(group, (first | (~F.col("_rich") & (after_n <= F.col("end")))).alias("in_val"))


def label_aware_split(
    df: DataFrame, group: str, ts: str, cutoff: Column, val_frac: float = 0.1, target: float | None = None,
    seed: int = 42, key: str = "id", **options,
) -> DataFrame:
    """I5 applied: test by time, val by label-aware groups."""
    early = df.filter(F.col(ts) <= cutoff)
    chosen = val_groups(early, group, val_frac, seed) if target is None else val_groups_for_ratio(early, group, val_frac, target, seed=seed, **options)
    return _assign(df, chosen, group, ts, cutoff, key)


def balance_check(df: DataFrame, ts: str, cutoff: Column, val_frac: float) -> DataFrame:
    """Can every split reach half positives, given the time cutoff?"""
    late, pos = F.col(ts) > cutoff, F.col("label") == 1
    c = df.agg(F.count_if(~late).alias("pre"), F.count_if(late).alias("post"), F.count_if(~late & pos).alias("pre_pos"), F.count_if(late & pos).alias("post_pos"))
    train_want = F.floor(F.lit(0.5) * F.col("pre") * (1 - val_frac))
    val_want = F.floor(F.lit(0.5) * F.col("pre") * val_frac)
    test_want = F.floor(F.lit(0.5) * F.col("post"))
    short = (F.col("pre_pos") < train_want + val_want * 0.5) | (F.col("post_pos") < test_want * 0.5)
    return c.withColumn("balance_possible", ~short)


def bounded(x: float, lo: float, hi: float) -> float:
    return max(lo, min(hi, x))


def stratified_split(df: DataFrame, test_frac: float, val_frac: float, seed: int = 42, key: str = "id", min_pos: int = 0) -> DataFrame:
    """Per class the first rows in hash order go to test, the next to val.

    ``min_pos`` raises the positive share of val, then test, to a minimum taken from train.
    """
    r = hash_ranked(df, key, seed, ["label"])
    size, pos = F.col("rank_of"), F.col("label") == 1
    floor_pos = F.when(pos, F.lit(min_pos)).otherwise(F.lit(0))
    val_n = F.least(size, F.greatest(floor_pos, F.bround(F.lit(val_frac) * size)))
    test_n = F.least(size - val_n, F.greatest(floor_pos, F.bround(F.lit(test_frac) * size)))
    side = F.when(F.col("rank") <= test_n, "test").when(F.col("rank") <= test_n + val_n, "val").otherwise("train")
    return r.withColumn("split", side).drop("rank", "rank_of")


def guarded_split(splits: DataFrame, val_frac: float, min_pos_val: int = 1, min_pos_test: int = 1, seed: int = 42, key: str = "id") -> DataFrame:
    """Keep the split unless val or test lacks positives; then split again by class, keeping the test share."""
    c = splits.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("test"),
                   *[F.count_if((F.col("split") == s) & (F.col("label") == 1)).alias(f"{s}_pos") for s in ("val", "test")]).first()
    if c.val_pos >= max(1, min_pos_val) and c.test_pos >= max(1, min_pos_test):
        return splits
    test_frac = bounded(c.test / max(1, c.n), 0.05, 0.8)
    return stratified_split(splits.drop("split"), test_frac, bounded(val_frac, 0.01, 0.49), seed, key, max(min_pos_val, min_pos_test, 1))


def return_smallest_group(splits: DataFrame, group: str) -> DataFrame:
    """I8: when train has no positives, the val group with fewest positives goes back to train."""
    train_pos = splits.filter("split = 'train' AND label = 1").limit(1).count()
    if train_pos:
        return splits
    stats = group_stats(splits.filter("split = 'val'"), group).filter("pos > 0")
    move = stats.agg(F.min_by(group, F.struct("pos", group)).alias("g")).first().g
    if move is None:
        return splits
    back = (F.col("split") == "val") & (F.col(group) == move)
    return splits.withColumn("split", F.when(back, "train").otherwise(F.col("split")))


def extend_splits(assigned: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows no split covers are appended to test; earlier assignments stay. Idempotent."""
    fresh = rows.join(assigned.select(key).distinct(), key, "left_anti").select(key).withColumn("split", F.lit("test"))
    return assigned.select(key, "split").unionByName(fresh)


def balanced_subset(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly n rows per class in hash order; an error when a class is too small."""
    sizes = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    short = {c: sizes.get(c, 0) for c in (0, 1) if sizes.get(c, 0) < n}
    if short:
        raise ValueError(f"too few rows for {n} per class: {short}")
    return hash_ranked(df, key, seed, ["label"]).filter(F.col("rank") <= n).drop("rank", "rank_of")


def folds(df: DataFrame, k: int, seed: int = 42, key: str = "id") -> DataFrame:
    """fold number per row, balanced within each class; k shrinks to the smaller class, never below 2."""
    c = df.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).first()
    k = max(2, min(k, c.pos, c.neg))
    r = hash_ranked(df, key, seed, ["label"])
    return r.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank", "rank_of")


def write_slices(rows: DataFrame, assigned: DataFrame, path: str, key: str = "id") -> None:
    """The table partitioned by split."""
    rows.join(assigned.select(key, "split"), key).write.mode("overwrite").partitionBy("split").parquet(path)


def read_slice(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("split") == split)
